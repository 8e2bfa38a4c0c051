"""The queries of ``plans.queries`` as DuckDB SQL over the same derived tables."""

from __future__ import annotations

from hostlore.plans.derived import VIEWS, WINDOW_SECONDS
from hostlore.plans.captures import CAPTURES

MOST = 32


def fixed(c: str, name: str) -> str:
    return f"strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS {name}"


def iso(c: str) -> str:
    return f"(strftime({c}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us({c}) % 1000000 = 0 THEN '' ELSE strftime({c}, '.%f') END || '+00:00')"


def digest(*parts: str) -> str:
    return "sha256(" + " || chr(0) || ".join(parts) + ")"


def joined(c: str, where: str = "") -> str:
    """Distinct values of a group, sorted, with bars between."""
    return f"coalesce(array_to_string(list_sort(list_distinct(list({c}){where})), '|'), '')"


def plain(s: str) -> str:
    return f"CASE WHEN {s}_active IS NULL THEN 'absent' ELSE {s}_load || '/' || {s}_active || '/' || {s}_sub END"


#: Lifecycles by joining each snapshot with the one before.
LIFE = """
done AS (SELECT s.host_id, s.snapshot_id, s.observed_at, s.monotonic_s, a.status = 'success' AS sc, b.status = 'success' AS pc
  FROM snapshots s JOIN collection_results a ON a.host_id = s.host_id AND a.snapshot_id = s.snapshot_id AND a.collector_name = 'services'
  JOIN collection_results b ON b.host_id = s.host_id AND b.snapshot_id = s.snapshot_id AND b.collector_name = 'processes'),
line AS (SELECT d.*, p.snapshot_id IS NOT NULL AS has_prev, coalesce(p.sc, false) AS psc, coalesce(p.pc, false) AS ppc, d.monotonic_s - p.monotonic_s AS elapsed
  FROM done d LEFT JOIN done p ON p.host_id = d.host_id AND p.snapshot_id = d.snapshot_id - 1),
svc_now AS (
  SELECT c.host_id, c.snapshot_id, l.observed_at, c.name,
    CASE WHEN p.name IS NULL THEN CASE WHEN l.has_prev AND l.psc AND l.sc THEN 'new' ELSE 'insufficient_history' END
         WHEN (p.load_state, p.active_state, p.sub_state) = (c.load_state, c.active_state, c.sub_state) THEN 'continuing' ELSE 'state_changed' END AS lifecycle,
    p.load_state AS p_load, p.active_state AS p_active, p.sub_state AS p_sub, c.load_state AS c_load, c.active_state AS c_active, c.sub_state AS c_sub
  FROM service_observations c JOIN line l ON l.host_id = c.host_id AND l.snapshot_id = c.snapshot_id
  LEFT JOIN service_observations p ON p.host_id = c.host_id AND p.name = c.name AND p.snapshot_id = c.snapshot_id - 1),
svc_gone AS (
  SELECT p.host_id, l.snapshot_id, l.observed_at, p.name, 'removed' AS lifecycle, p.load_state AS p_load, p.active_state AS p_active, p.sub_state AS p_sub,
    CAST(NULL AS VARCHAR) AS c_load, CAST(NULL AS VARCHAR) AS c_active, CAST(NULL AS VARCHAR) AS c_sub
  FROM service_observations p JOIN line l ON l.host_id = p.host_id AND l.snapshot_id = p.snapshot_id + 1
  WHERE l.sc AND l.psc AND NOT EXISTS (SELECT 1 FROM service_observations c WHERE c.host_id = p.host_id AND c.name = p.name
    AND c.snapshot_id = p.snapshot_id + 1)),
svc AS (SELECT * FROM svc_now UNION ALL SELECT * FROM svc_gone),
prc_now AS (
  SELECT c.host_id, c.snapshot_id, l.observed_at, c.pid, c.lifetime_id,
    CASE WHEN NOT l.has_prev THEN 'insufficient_history' WHEN c.lifetime_id IS NULL THEN 'invalid' WHEN p.pid IS NOT NULL THEN 'continuing'
         WHEN q.pid IS NOT NULL THEN 'identity_changed' WHEN l.ppc THEN 'new' ELSE 'insufficient_history' END AS lifecycle,
    p.cpu_time_ticks AS p_cpu, c.cpu_time_ticks AS c_cpu, l.elapsed, l.has_prev, c.rss_bytes - p.rss_bytes AS rss_delta, c.virtual_memory_bytes -
      p.virtual_memory_bytes AS vm_delta, p.pid IS NOT NULL AS same, z.pid IS NOT NULL AS pid_seen
  FROM process_observations c JOIN line l ON l.host_id = c.host_id AND l.snapshot_id = c.snapshot_id
  LEFT JOIN process_observations p ON p.host_id = c.host_id AND p.lifetime_id = c.lifetime_id AND p.snapshot_id = c.snapshot_id - 1
  LEFT JOIN process_observations q ON q.host_id = c.host_id AND q.pid = c.pid AND q.snapshot_id = c.snapshot_id - 1 AND q.lifetime_id IS NOT NULL
  LEFT JOIN process_observations z ON z.host_id = c.host_id AND z.pid = c.pid AND z.snapshot_id = c.snapshot_id - 1),
prc_gone AS (
  SELECT p.host_id, l.snapshot_id, l.observed_at, p.pid, p.lifetime_id, 'exited' AS lifecycle FROM process_observations p
    JOIN line l ON l.host_id = p.host_id AND l.snapshot_id = p.snapshot_id + 1
  WHERE l.pc AND l.ppc AND p.lifetime_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM process_observations c WHERE c.host_id = p.host_id
    AND c.pid = p.pid AND c.snapshot_id = p.snapshot_id + 1)),
prc AS (SELECT host_id, snapshot_id, observed_at, pid, lifetime_id, lifecycle FROM prc_now UNION ALL SELECT * FROM prc_gone)"""

CORR = f"""
{LIFE},
anchor AS (
  SELECT *, {plain('p')} AS p_text, {plain('c')} AS c_text FROM svc
  WHERE lifecycle = 'removed' OR lifecycle = 'state_changed' AND c_active IN ('failed', 'inactive', 'deactivating')),
anchors AS (
  SELECT a.*, 'service:' || {digest("'service-change-v1'", "name", iso("observed_at"), "lifecycle", "p_text", "c_text")} AS change_id,
    CASE WHEN r.status <> 'success' THEN 'services_collection_' || r.status END AS own_limit
  FROM anchor a JOIN collection_results r ON r.host_id = a.host_id AND r.snapshot_id = a.snapshot_id AND r.collector_name = 'services'),
near_events AS (
  SELECT a.host_id, a.name, a.observed_at, a.change_id, 'journal_event' AS kind, 'journal:' || e.cursor AS evidence_id, e.observed_at AS
    evidence_at, 'service_unit_match' AS reason,
    'journal event' || coalesce(' priority ' || e.priority, '') AS summary, 'journal_unit_event' AS fact, CAST(NULL AS VARCHAR) AS e_limit
  FROM anchors a JOIN journal_events e ON e.host_id = a.host_id AND e.unit = a.name
    AND abs(epoch_us(e.observed_at) - epoch_us(a.observed_at)) <= {WINDOW_SECONDS}000000),
near_processes AS (
  SELECT a.host_id, a.name, a.observed_at, a.change_id, 'process_change' AS kind, 'process:' ||
    {digest("'process-change-v1'", "p.lifetime_id", iso("p.observed_at"), "p.lifecycle")} AS evidence_id, p.observed_at AS evidence_at,
    'explicit_process_association' AS reason, 'associated process lifetime ' || p.lifetime_id || ' ' || p.lifecycle AS summary,
    CASE p.lifecycle WHEN 'exited' THEN 'process_exited' WHEN 'new' THEN 'process_started' ELSE 'process_identity_changed' END AS fact,
    CASE WHEN r.status <> 'success' THEN 'processes_collection_' || r.status END AS e_limit
  FROM anchors a JOIN associations s ON s.host_id = a.host_id AND s.service_name = a.name JOIN prc p ON p.host_id = a.host_id AND p.lifetime_id = s.lifetime_id
  JOIN collection_results r ON r.host_id = p.host_id AND r.snapshot_id = p.snapshot_id AND r.collector_name = 'processes'
  WHERE p.lifecycle IN ('new', 'exited', 'identity_changed') AND abs(epoch_us(p.observed_at) - epoch_us(a.observed_at)) <= {WINDOW_SECONDS}000000),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY host_id, change_id ORDER BY abs(epoch_us(evidence_at) - epoch_us(observed_at)), evidence_at, kind,
    evidence_id) AS place
  FROM (SELECT * FROM near_events UNION ALL SELECT * FROM near_processes)),
kept AS (SELECT * FROM placed WHERE place <= MOST - 1),
both_kinds AS (
  SELECT host_id, name, observed_at, change_id, kind, evidence_id, evidence_at, reason, summary, fact, e_limit FROM kept
  UNION ALL
  SELECT a.host_id, name, observed_at, change_id, 'service_change', change_id, observed_at, 'service_change_anchor', 'service ' || lifecycle ||
    ': ' || p_text || ' -> ' || c_text,
    CASE WHEN lifecycle = 'removed' THEN 'service_removed' ELSE 'service_' || c_active END, own_limit FROM anchors a WHERE EXISTS (SELECT 1
      FROM kept k WHERE k.host_id = a.host_id AND k.change_id = a.change_id)),
evidence AS (SELECT *, {digest("'incident-v1'", "'service-condition-v1'", "name", "change_id")} AS incident_id FROM both_kinds),
candidates AS (
  SELECT e.host_id, incident_id, name AS subject_id, e.observed_at AS started_at, max(evidence_at) AS last_observed_at, count(*) AS n_evidence,
    list_sort(list_distinct(list_concat(list(e_limit) FILTER (WHERE e_limit IS NOT NULL), list('journal_collection_' || r.status) FILTER (WHERE
      r.status <> 'success')))) AS limitations
  FROM evidence e LEFT JOIN collection_results r ON r.host_id = e.host_id AND r.collected_at = e.observed_at AND r.collector_name = 'journal'
  GROUP BY e.host_id, incident_id, name, e.observed_at),
cuts AS (SELECT host_id, observed_at AS cut_at FROM snapshots WHERE snapshot_id = 15),
old_half AS (SELECT c.* FROM candidates c JOIN cuts USING (host_id) WHERE started_at <= cut_at),
new_half AS (SELECT c.* FROM candidates c JOIN cuts USING (host_id) WHERE started_at > cut_at - INTERVAL 5 DAY),
merged AS (
  SELECT host_id, incident_id, coalesce(o.subject_id, n.subject_id) AS subject_id, coalesce(o.started_at, n.started_at) AS started_at,
    coalesce(o.last_observed_at, n.last_observed_at) AS last_observed_at,
    CASE WHEN o.subject_id IS NULL THEN 'inserted' WHEN n.subject_id IS NULL THEN 'stored' ELSE 'kept' END AS change
  FROM old_half o FULL JOIN new_half n USING (host_id, incident_id)),
back AS (SELECT DISTINCT host_id, snapshot_id, name AS subject_id FROM svc WHERE lifecycle = 'state_changed' AND c_active = 'active'),
recovery AS (
  SELECT b.host_id, b.subject_id, r.collected_at AS back_at FROM back b JOIN collection_results r ON r.host_id = b.host_id
    AND r.snapshot_id = b.snapshot_id AND r.collector_name = 'services' AND r.status = 'success'
  WHERE NOT EXISTS (SELECT 1 FROM candidates n WHERE n.host_id = b.host_id AND n.subject_id = b.subject_id AND n.started_at = r.collected_at)),
times AS (
  SELECT m.host_id, m.incident_id, min(back_at) AS back_at FROM merged m JOIN recovery r ON r.host_id = m.host_id AND r.subject_id = m.subject_id
    AND r.back_at >= m.started_at GROUP BY m.host_id, m.incident_id),
resolved AS (
  SELECT m.host_id, m.incident_id, m.subject_id, m.started_at, change, coalesce(back_at >= last_observed_at, false) AS now_resolved, CASE
    WHEN back_at >= last_observed_at THEN 'resolved' ELSE 'active' END AS state,
    CASE WHEN back_at >= last_observed_at THEN back_at ELSE last_observed_at END AS last_observed_at, CASE
      WHEN back_at >= last_observed_at THEN back_at END AS resolved_at,
    CASE WHEN back_at < last_observed_at THEN 'resolution_before_evidence' END AS problem
  FROM merged m LEFT JOIN times t ON t.host_id = m.host_id AND t.incident_id = m.incident_id)"""



def corr(events: str, snapshots: str, window_seconds: int) -> str:
    """The same over other tables of events and snapshots, with another window."""
    text = CORR.replace("JOIN journal_events", f"JOIN {events}").replace("FROM snapshots", f"FROM {snapshots}")
    return text.replace(f"{WINDOW_SECONDS}000000", f"{window_seconds}000000").lstrip()


#: The texts of the explanations, written out here on their own so that the check sees a change of them.
TEXT_CASE = """CASE rule
  WHEN 'unsupported_service_condition' THEN
    ' has an incident candidate, but its opening condition is not established as a service failure by the available structured evidence.'
  WHEN 'service_failure_journal_process_exit' THEN
    ' entered a failed state. An exact-unit journal event and an explicitly associated process lifetime termination occurred within the incident evidence interval.'
  WHEN 'service_failure_journal' THEN ' entered a failed state and an exact-unit journal event occurred within the incident evidence interval.'
  WHEN 'service_failure_process_exit' THEN ' entered a failed state and an explicitly associated process lifetime ended within the incident evidence interval.'
  WHEN 'service_failure_insufficient' THEN ' entered a failed state, but the incident contains no exact-unit journal event or explicitly associated process termination.' END"""
CLOSING = " These facts satisfy deterministic relationship rules. The exact root cause and causal direction are not established."
CONTEXT = " Evidence context is incomplete, so unobserved facts may change interpretation."


def past(most: int) -> str:
    return f"""
pool AS (SELECT *, row_number() OVER (PARTITION BY host_id, subject_id ORDER BY last_observed_at DESC, incident_id) AS rk FROM candidates),
pairs AS (
  SELECT c.host_id, c.incident_id, p.incident_id AS past_id, p.started_at AS past_at, row_number() OVER (PARTITION BY c.host_id, c.incident_id
    ORDER BY p.started_at DESC, p.incident_id DESC) AS rk
  FROM candidates c JOIN pool p ON p.host_id = c.host_id AND p.subject_id = c.subject_id AND p.started_at < c.started_at
    AND p.incident_id <> c.incident_id AND p.rk <= 1000),
hist AS (SELECT host_id, incident_id, list(past_id ORDER BY past_at, past_id) AS history FROM pairs WHERE rk <= {most} GROUP BY host_id, incident_id)"""


DIAG = past(
    20
) + f""",
facts AS (
  SELECT host_id, incident_id, max(CASE WHEN reason = 'service_change_anchor' THEN fact END) AS anchor, bool_or(fact = 'journal_unit_event') AS
    j, bool_or(fact = 'process_exited') AS x FROM evidence GROUP BY host_id, incident_id),
ruled AS (
  SELECT c.*, f.anchor, coalesce(len(h.history), 0) AS n, CASE WHEN anchor <> 'service_failed' THEN 'unsupported_service_condition' WHEN j
    AND x THEN 'service_failure_journal_process_exit' WHEN j THEN 'service_failure_journal'
    WHEN x THEN 'service_failure_process_exit' ELSE 'service_failure_insufficient' END AS rule
  FROM candidates c JOIN facts f USING (host_id, incident_id) LEFT JOIN hist h USING (host_id, incident_id)),
chosen AS (
  SELECT r.host_id, r.incident_id, list(e.evidence_id ORDER BY e.evidence_at, e.kind, e.evidence_id) AS ids, list(e.e_limit) FILTER (WHERE
    e.e_limit IS NOT NULL) AS lims
  FROM ruled r JOIN evidence e USING (host_id, incident_id)
  WHERE e.reason = 'service_change_anchor' OR r.rule IN ('service_failure_journal_process_exit', 'service_failure_journal',
    'service_failure_process_exit') AND e.fact IN ('journal_unit_event', 'process_exited') GROUP BY ALL),
diag AS (
  SELECT r.*, c.ids, list_sort(list_distinct(list_concat(r.limitations, c.lims, CASE rule
    WHEN 'unsupported_service_condition' THEN ['service_condition_not_supported_by_diagnostic_rules']
    WHEN 'service_failure_journal' THEN ['associated_process_termination_not_observed']
    WHEN 'service_failure_process_exit' THEN ['exact_unit_journal_evidence_not_observed']
      WHEN 'service_failure_insufficient' THEN ['insufficient_diagnostic_evidence'] ELSE [] END))) AS lim
  FROM ruled r JOIN chosen c USING (host_id, incident_id))"""


def sql(body: str, *parts: str, most: int = MOST) -> str:
    return (f"WITH {VIEWS}, {CAPTURES}" + "".join(f",{p}" for p in parts) + "\n" + body).replace("MOST", str(most))


def walked(body: str, *parts: str) -> str:
    """``sql`` with a part that walks from row to row."""
    return sql(body, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def ct(prev: str, cur: str, elapsed: str, missing: str) -> str:
    return f"CASE WHEN {prev} IS NULL THEN {missing} WHEN NOT ({elapsed} > 0) THEN 'invalid_interval' " f"WHEN {prev} < 0 OR {cur} < 0 THEN 'invalid_data' WHEN {cur} < {prev} THEN 'counter_reset' ELSE 'valid' END"


def rates(table: str, key: str, *counters: str, where: str = "") -> str:
    state = {c: ct(f"p.{c}", f"c.{c}", "l.elapsed", "CASE WHEN l.has_prev THEN 'new_resource' ELSE 'no_previous' END") for c in counters}
    cols = ", ".join(f"{s} AS {c}_state, CASE WHEN {s} = 'valid' THEN c.{c} - p.{c} END AS {c}_delta, CASE WHEN {s} = 'valid' THEN (c.{c} - p.{c}) / l.elapsed END AS {c}_rate" for c, s in state.items())
    return f"SELECT c.host_id, c.snapshot_id, c.{key}, {cols} FROM {table} c JOIN line l ON l.host_id = c.host_id " f"AND l.snapshot_id = c.snapshot_id LEFT JOIN {table} p ON p.host_id = c.host_id AND p.{key} = c.{key} " f"AND p.snapshot_id = c.snapshot_id - 1 {where}"


def gone(table: str, key: str) -> str:
    return f"SELECT p.host_id, p.snapshot_id + 1 AS snapshot_id, p.{key} FROM {table} p " f"JOIN snapshots s ON s.host_id = p.host_id AND s.snapshot_id = p.snapshot_id + 1 WHERE p.{key} IS NOT NULL " f"AND NOT EXISTS (SELECT 1 FROM {table} c WHERE c.host_id = p.host_id AND c.{key} = p.{key} " f"AND c.snapshot_id = p.snapshot_id + 1)"


CPU = """
cpu AS (SELECT c.*, l.elapsed, l.has_prev, p.snapshot_id IS NULL AS none, (c.user_ticks - p.user_ticks) + (c.nice_ticks - p.nice_ticks) +
  (c.system_ticks - p.system_ticks) AS busy,
    (c.user_ticks - p.user_ticks) + (c.nice_ticks - p.nice_ticks) + (c.system_ticks - p.system_ticks) + (c.idle_ticks - p.idle_ticks) +
      (c.iowait_ticks - p.iowait_ticks) AS total
  FROM cpu_observations c JOIN line l USING (host_id, snapshot_id) LEFT JOIN cpu_observations p ON p.host_id = c.host_id AND p.snapshot_id = c.snapshot_id - 1),
cpus AS (SELECT *, CASE WHEN none THEN 'no_previous' WHEN NOT (elapsed > 0) THEN 'invalid_interval' WHEN total <= 0 THEN 'invalid_data' ELSE 'valid' END AS state FROM cpu)"""

PROCESS_RATES = (
    "SELECT host_id, snapshot_id, pid, lifetime_id, state, CASE WHEN state = 'valid' THEN c_cpu - p_cpu END AS delta, "
    "CASE WHEN state = 'valid' THEN (c_cpu - p_cpu) / elapsed END AS rate "
    "FROM (SELECT *, CASE WHEN NOT has_prev THEN 'no_previous' WHEN lifetime_id IS NULL THEN 'identity_mismatch' WHEN same THEN "
    + ct("p_cpu", "c_cpu", "elapsed", "'no_previous'")
    + " WHEN pid_seen THEN 'identity_mismatch' ELSE 'new_resource' END AS state FROM prc_now)"
)
SVC2 = "svc2 AS (SELECT * FROM service_observations UNION ALL SELECT * FROM service_observations WHERE snapshot_id = 3)"
LIMS = "array_to_string(limitations, '|') AS limitations"
D_STATE = "CASE WHEN rule = 'unsupported_service_condition' THEN 'unknown' " "WHEN rule = 'service_failure_insufficient' THEN 'insufficient_evidence' ELSE 'supported' END AS state"
D_FACTS = """concat_ws('|', CASE WHEN rule = 'unsupported_service_condition' THEN anchor ELSE 'service_failed' END, CASE
  WHEN rule LIKE 'service_failure_journal%' THEN 'exact_unit_journal_event' END,
  CASE WHEN rule LIKE '%process_exit' THEN 'associated_process_lifetime_exited' END, CASE WHEN n > 0 THEN 'prior_incident_candidates:' || n END) AS facts"""
D_TEXT = f"""subject_id || {TEXT_CASE} || CASE WHEN n > 0 THEN ' ' || n || ' earlier incident candidate' || CASE WHEN n = 1 THEN ''
  ELSE 's' END || ' for the same service are recorded; this does not establish a recurring cause.' ELSE '' END || '{CLOSING}'
  || CASE WHEN len(list_filter(lim, lambda v: regexp_matches(v, 'partial|unavailable|denied|failure|unsupported|invalid|unknown'))) > 0 THEN '{CONTEXT}' ELSE '' END AS explanation"""
CYCLE_LIMITS = """(SELECT coalesce(string_agg(w, '|' ORDER BY w), '') FROM (SELECT CASE
  WHEN collector_name = 'journal' THEN 'journal_collection_' ELSE 'collector_' || collector_name || '_' END || status AS w
  FROM collection_results r WHERE r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id AND status <> 'success')) AS limitations"""


def listed(table: str, text: str, order: str, name: str) -> str:
    """The rows of a snapshot as one text."""
    return f"(SELECT coalesce(string_agg({text}, '|' ORDER BY {order}), '') FROM {table} o WHERE o.host_id = s.host_id " f"AND o.snapshot_id = s.snapshot_id) AS {name}"


def number_of(table: str) -> str:
    return f"(SELECT count(*) FROM {table} o WHERE o.host_id = s.host_id AND o.snapshot_id = s.snapshot_id)"


def oracles() -> dict[str, str]:
    bad17 = "snapshot_id % 17 = 0"
    ok17 = f"NOT ({bad17})"
    pick = lambda c, ok, name=None: f"CASE WHEN {ok} THEN {c} END AS {name or c}"
    out: dict[str, str] = {}
    out["ingest_cpu"] = sql(
        f"SELECT host_id, snapshot_id, {ok17} AS valid, "
        + ", ".join(pick(f"{x}_ticks", ok17) for x in ("user", "nice", "system", "idle", "iowait", "irq", "softirq", "steal"))
        + " FROM cpu_observations"
    )
    out["ingest_memory"] = sql(
        f"SELECT host_id, snapshot_id, {ok17} AS valid, "
        + ", ".join(pick(f"{c}_kb * 1024", ok17, f"{c}_bytes") for c in ("total", "available", "free", "buffers"))
        + ", CAST(NULL AS BIGINT) AS cached_bytes, CAST(NULL AS BIGINT) AS swap_total_bytes, CAST(NULL AS BIGINT) AS "
        "swap_free_bytes FROM memory_observations"
    )
    fixed_counts = {"receive_packets": 1, "transmit_packets": 4, "receive_errors": 2, "transmit_errors": 5, "receive_drops": 3, "transmit_drops": 6}
    counted = ", ".join(f"CAST({v} AS BIGINT) AS {c}" for c, v in fixed_counts.items())
    out["ingest_network"] = sql(
        f"SELECT host_id, snapshot_id, true AS valid, interface, receive_bytes, transmit_bytes, {counted} FROM network_observations "
        f"WHERE (host_id, snapshot_id) NOT IN (SELECT (host_id, snapshot_id) FROM bad_network) "
        f"UNION ALL SELECT host_id, snapshot_id, false, NULL, NULL, NULL{', NULL' * len(fixed_counts)} FROM bad_network",
        "bad_network AS (SELECT DISTINCT host_id, snapshot_id FROM network_observations WHERE snapshot_id % 17 = 0 AND interface = 'if-view')",
    )
    values = {
        "ppid": "1", "name": "name || ' (x) y'", "state": "'S'", "rss_bytes": "rss_bytes * 4096", "virtual_memory_bytes": "4 * rss_bytes", "threads": "1",
        "cpu_time_ticks": "cpu_time_ticks + 5", "start_time_ticks": "coalesce(start_time_ticks, 0)", "command": "'/bin/' || name || ' --token [REDACTED]'",
        "executable": "CASE WHEN pid % 2 = 0 THEN '/bin/' || name END", "lifetime_id": "pid || ':' || coalesce(start_time_ticks, 0)",
    }
    valid = ", ".join(pick(v, "ok", c) for c, v in values.items())
    out["ingest_processes"] = sql(f"SELECT host_id, snapshot_id, pid, ok AS valid, {valid} FROM (SELECT *, pid % 17 <> 1 AS ok FROM process_observations)")
    out["ingest_services"] = sql(
        "SELECT host_id, snapshot_id, true AS valid, name, load_state, active_state, sub_state FROM service_observations "
        "WHERE (host_id, snapshot_id) NOT IN (SELECT (host_id, snapshot_id) FROM bad_services) "
        "UNION ALL SELECT host_id, snapshot_id, false, NULL, NULL, NULL, NULL FROM bad_services",
        "bad_services AS (SELECT host_id, snapshot_id FROM service_observations GROUP BY host_id, snapshot_id "
        "HAVING snapshot_id % 17 = 0 OR snapshot_id % 13 = 5 AND count(*) > 1)",
    )
    out["ingest_system"] = sql(
        f"SELECT host_id, snapshot_id, {ok17} AS valid, CASE "
        f"WHEN {ok17} THEN snapshot_id + 0.25::DOUBLE END AS uptime_seconds FROM raw_uptime"
    )
    out["ingest_disk"] = sql(
        "SELECT host_id, snapshot_id, path, blocks * 4096 AS total_bytes, (blocks - available_blocks) * 4096 AS used_bytes, "
        "available_blocks * 4096 AS free_bytes FROM disk_observations"
    )
    values = {
        "cursor": "cursor", "at_us": "1700000000000000 + event_id", "source": "'journal'", "priority": "priority", "unit": "unit", "pid": "pid",
        "comm": "CASE WHEN comm = 'view' THEN 'vi' ELSE 'ab' END", "message": "comm || ' token=[REDACTED] end'", "boot_id": "CAST(NULL AS VARCHAR)", "warnings": "'message_redacted'",
    }
    valid = ", ".join(pick(v, "ok", c) for c, v in values.items())
    out["ingest_journal"] = sql(f"SELECT host_id, page, pos, ok AS valid, {valid} FROM (SELECT *, event_id % 17 <> 0 AS ok FROM raw_journal)")
    out["collection_status"] = sql(
        "SELECT host_id, snapshot_id, CASE WHEN snapshot_id % 7 = 3 THEN CASE "
        "WHEN snapshot_id % 2 = 0 THEN 'permission_denied' ELSE 'transient_failure' END WHEN snapshot_id % 17 = 0 "
        "AND snapshot_id % 9 <> 5 THEN 'invalid_data' ELSE 'success' END AS status FROM snapshots"
    )
    out["process_partial_status"] = sql(
        """SELECT host_id, snapshot_id, count(*) FILTER (WHERE k <= 20 AND problem IS NULL) AS n_valid,
          coalesce(string_agg(w, '|' ORDER BY w), '') AS warnings, CASE WHEN count(w) > 0 THEN 'partial' ELSE 'success' END AS status
          FROM (SELECT *, CASE WHEN k = 21 THEN 'process observation limit reached (20)' WHEN k <= 20 THEN 'process ' || pid || ' ' || problem END AS w
            FROM (SELECT *, row_number() OVER (PARTITION BY host_id, snapshot_id ORDER BY pid) AS k, CASE WHEN pid % 13 = 5 THEN CASE
              WHEN pid % 2 = 0 THEN 'disappeared during collection' ELSE 'was inaccessible' END
              WHEN pid % 17 = 1 THEN 'returned malformed data' END AS problem FROM process_observations)) GROUP BY host_id, snapshot_id"""
    )
    out["process_topn_by_pid"] = sql(
        "SELECT host_id, snapshot_id, pid, n > 3 AS limited "
        "FROM (SELECT *, count(*) OVER (PARTITION BY host_id, snapshot_id) AS n, row_number() OVER (PARTITION BY host_id, "
        "snapshot_id ORDER BY pid) AS k FROM process_observations) WHERE k <= 3"
    )
    out["journal_page_accept"] = walked(
        """SELECT host_id, page, outcome, CAST(CASE WHEN outcome IN ('success', 'partial') THEN least(n - skip, 60) ELSE 0 END AS BIGINT) AS accepted, next_cursor
          FROM walk WHERE k > 0""",
        """
page_all AS (
  SELECT j.host_id, j.page, row_number() OVER (PARTITION BY j.host_id ORDER BY j.page) AS k, coalesce(n, 0) AS n, coalesce(ok, true) AS ok,
    coalesce(len(list_distinct(cursors)), 0) AS different, cursors
  FROM (SELECT DISTINCT host_id, page FROM raw_journal) j LEFT JOIN (SELECT host_id, page, count(*) AS n, bool_and(valid) AS ok, list(cursor ORDER BY pos) AS cursors
    FROM raw_pages GROUP BY host_id, page) p ON p.host_id = j.host_id AND p.page = j.page),
walk AS (
  SELECT host_id, CAST(0 AS BIGINT) AS page, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS n, 0 AS skip, '' AS outcome, CAST(NULL AS VARCHAR) AS next_cursor
  FROM (SELECT DISTINCT host_id FROM raw_journal)
  UNION ALL
  SELECT host_id, page, k, n, skip, outcome, CASE WHEN outcome NOT IN ('success', 'partial') OR n = 0 THEN saved WHEN outcome = 'partial'
    THEN cursors[60 + skip] ELSE cursors[n] END FROM (
    SELECT *, CASE WHEN NOT ok THEN 'journal_invalid' WHEN skip = 1 AND cursors[1] IS DISTINCT FROM saved THEN 'journal_cursor_invalidated'
      WHEN different < n THEN 'journal_duplicate_cursor' WHEN n - skip > 60 THEN 'partial' ELSE 'success' END AS outcome
    FROM (SELECT p.*, w.next_cursor AS saved, CASE WHEN w.next_cursor IS NULL THEN 0 ELSE 1 END AS skip FROM walk w JOIN page_all p ON p.host_id = w.host_id
      AND p.k = w.k + 1)))""",
    )
    parts = {"services": "service", "processes": "process", "network": "network", "cpu": "cpu", "memory": "memory", "disk": "disk"}
    counts = ", ".join(f"{number_of(f'{table}_observations')} AS n_{name}" for name, table in parts.items())
    statuses = listed("collection_results", "collector_name || '=' || status", "collector_name", "statuses")
    warnings = """(SELECT coalesce(string_agg(collector_name || ' was ' || status || '|' || collector_name || ' again', '|' ORDER BY CASE collector_name
      WHEN 'processes' THEN 4 WHEN 'services' THEN 7 ELSE 8 END), '') FROM collection_results o WHERE o.host_id = s.host_id AND o.snapshot_id = s.snapshot_id
      AND status <> 'success') AS warnings"""
    out["assemble_snapshot"] = sql(f"SELECT s.host_id, s.snapshot_id, {fixed('observed_at', 'observed_at')}, {statuses}, {warnings}, {counts} FROM snapshots s")
    out["events_append_new"] = sql(f"SELECT host_id, cursor, {fixed('observed_at', 'observed_at')} FROM journal_events WHERE snapshot_id > 15")
    out["journal_batch_gate"] = walked(
        "SELECT host_id, snapshot_id, met AS saved, reason IS NULL AS accepted, reason FROM walk WHERE k > 0",
        """
batch_all AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY snapshot_id) AS k FROM raw_batches),
walk AS (
  SELECT host_id, CAST(0 AS BIGINT) AS snapshot_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS met, CAST(NULL AS VARCHAR) AS reason,
    CASE WHEN host_id IN ('host-1', 'host-3') THEN 'c-start' END AS saved FROM (SELECT DISTINCT host_id FROM raw_batches)
  UNION ALL
  SELECT host_id, snapshot_id, k, met, reason, CASE WHEN reason IS NULL AND n_events > 0 THEN next_cursor ELSE met END FROM (
    SELECT b.*, w.saved AS met, CASE WHEN expected_cursor IS DISTINCT FROM w.saved THEN 'checkpoint_changed'
      WHEN n_events > 0 AND next_cursor IS DISTINCT FROM last_cursor THEN 'checkpoint_not_last_event'
      WHEN n_events = 0 AND next_cursor IS DISTINCT FROM w.saved THEN 'empty_batch_moves_checkpoint' END AS reason
    FROM walk w JOIN batch_all b ON b.host_id = w.host_id AND b.k = w.k + 1))""",
    )
    out["advance_checkpoint"] = sql(
        f"SELECT host_id, source, max_by(cursor, event_id) AS cursor, {fixed('max(observed_at)', 'updated_at')} "
        f"FROM journal_events GROUP BY host_id, source"
    )
    out["latest_journal_quality"] = sql(
        f"""SELECT host_id, collector_name, snapshot_id, status, {fixed('collected_at', 'collected_at')}, CASE
          WHEN status NOT IN ('success', 'partial') THEN NULL WHEN collector_name = 'journal' THEN {number_of('journal_events').replace('s.', 'r.')}
          ELSE 0 END AS event_count, snapshot_id * 0.5::DOUBLE AS duration_seconds, CASE WHEN status <> 'success' THEN collector_name || '_' || status END AS error_code
          FROM collection_results r WHERE snapshot_id = (SELECT max(snapshot_id) FROM snapshots s WHERE s.host_id = r.host_id)"""
    )
    good = "WHERE (host_id, snapshot_id) NOT IN (SELECT (host_id, snapshot_id) FROM refused)"
    out["snapshot_fanout"] = sql(
        f"SELECT host_id, snapshot_id, 'services' AS part, name AS child FROM service_observations {good} UNION ALL "
        f"SELECT host_id, snapshot_id, 'processes', CAST(pid AS VARCHAR) FROM process_observations {good} UNION ALL "
        f"SELECT host_id, snapshot_id, 'network', interface FROM network_observations {good}",
        "refused AS (SELECT host_id, snapshot_id FROM service_observations WHERE snapshot_id = 3 UNION SELECT host_id, snapshot_id FROM snapshots "
        "WHERE snapshot_id IN (5, 8))",
    )
    out["snapshot_publish"] = out["snapshot_fanout"].replace(
        "FROM snapshots WHERE snapshot_id IN (5, 8)", "FROM snapshots WHERE snapshot_id IN (5, 8) OR snapshot_id <= 4"
    )
    out["snapshot_rebuild"] = sql(
        """SELECT s.host_id, s.snapshot_id, (SELECT string_agg(collector_name || '=' || status, '|' ORDER BY collector_name)
          FROM collection_results r WHERE r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id) AS results,
          (SELECT string_agg(name || '/' || active_state, '|' ORDER BY name) FROM service_observations r WHERE r.host_id = s.host_id
            AND r.snapshot_id = s.snapshot_id) AS services,
          (SELECT CAST(nullif(count(*), 0) AS INT) FROM process_observations r WHERE r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id) AS n_processes FROM snapshots s"""
    )
    out["events_recent"] = sql(
        f"SELECT host_id, cursor, {fixed('t', 'observed_at')} FROM (SELECT host_id, cursor, observed_at AS t "
        f"FROM journal_events WHERE observed_at < TIMESTAMP '2024-01-20' ORDER BY observed_at DESC, cursor DESC LIMIT 50)"
    )
    out["event_window"] = sql(
        f"SELECT host_id, cursor, {fixed('t', 'observed_at')}, CAST(k AS INT) AS place, n > 10 AS truncated "
        f"FROM (SELECT host_id, cursor, observed_at AS t, row_number() OVER (ORDER BY observed_at, cursor) AS k, count(*) "
        f"OVER () AS n FROM journal_events WHERE unit = 'svc-5.service' AND observed_at BETWEEN TIMESTAMP '2024-01-03' "
        f"AND TIMESTAMP '2024-01-25') WHERE k <= 10"
    )
    out["events_for_anchors"] = sql(
        f"""SELECT host_id, {fixed('observed_at', 'observed_at')}, evidence_id, {fixed('evidence_at', 'evidence_at')}, n > 1000 AS truncated FROM (
          SELECT *, count(*) OVER (PARTITION BY host_id, observed_at) AS n, row_number() OVER (PARTITION BY host_id, observed_at
            ORDER BY evidence_at, evidence_id) AS k
          FROM (SELECT DISTINCT host_id, observed_at, evidence_id, evidence_at FROM near_events)) WHERE k <= 1000""",
        CORR,
    )
    out["incidents_recent"] = sql(
        f"SELECT host_id, incident_id, {fixed('l', 'last_observed_at')} "
        f"FROM (SELECT host_id, incident_id, last_observed_at AS l FROM resolved WHERE state = 'active' "
        f"ORDER BY last_observed_at DESC, incident_id LIMIT 40)",
        CORR,
    )
    out["incident_detail"] = sql(
        f"SELECT c.host_id, c.incident_id, subject_id, (SELECT string_agg(evidence_id, '|' "
        f"ORDER BY evidence_at, kind, evidence_id) FROM evidence e WHERE e.host_id = c.host_id "
        f"AND e.incident_id = c.incident_id) AS evidence_ids, {LIMS} FROM candidates c",
        CORR,
    )
    out["counter_rate"] = sql(rates("process_observations", "lifetime_id", "cpu_time_ticks", where="WHERE c.lifetime_id IS NOT NULL"), LIFE)
    values = {"total": "total", "busy": "busy", "utilisation": "busy / total", "busy_rate": "busy / elapsed"}
    valid = ", ".join(f"CASE WHEN state = 'valid' THEN {v} END AS {c}" for c, v in values.items())
    out["cpu_utilization"] = sql(f"SELECT host_id, snapshot_id, state, {valid} FROM cpus", LIFE, CPU)
    out["network_rates"] = sql(rates("network_observations", "interface", "receive_bytes", "transmit_bytes"), LIFE)
    out["network_removed"] = sql(
        gone("net2", "interface"), "net2 AS (SELECT * FROM network_observations WHERE NOT (interface = 'if-view' AND snapshot_id % 6 = 0))"
    )
    out["process_cpu_rates"] = sql(PROCESS_RATES, LIFE)
    out["process_lifetimes_removed"] = sql(gone("process_observations", "lifetime_id"))
    out["derived_identity"] = sql(
        "SELECT c.host_id, c.snapshot_id, user_ticks + nice_ticks + system_ticks + idle_ticks + iowait_ticks AS "
        "total_ticks, pid, lifetime_id FROM cpu_observations c JOIN process_observations p USING (host_id, snapshot_id)"
    )
    out["process_memory_delta"] = sql("SELECT host_id, snapshot_id, pid, rss_delta, vm_delta FROM prc_now WHERE lifecycle = 'continuing'", LIFE)
    out["process_lifecycle"] = sql(
        f"SELECT host_id, snapshot_id, {fixed('observed_at', 'observed_at')}, pid, lifetime_id, lifecycle, CASE "
        f"WHEN lifecycle = 'continuing' THEN st END AS cpu_state, CASE WHEN lifecycle = 'continuing' "
        f"AND st = 'valid' THEN c_cpu - p_cpu END AS cpu_delta "
        f"FROM (SELECT *, {ct('p_cpu', 'c_cpu', 'elapsed', chr(39) + 'no_previous' + chr(39))} AS st FROM prc_now) UNION ALL "
        f"SELECT host_id, snapshot_id, {fixed('observed_at', 'observed_at')}, pid, lifetime_id, lifecycle, NULL, NULL "
        f"FROM prc_gone",
        LIFE,
    )
    out["service_lifecycle"] = sql(
        f"SELECT host_id, snapshot_id, name, lifecycle, {fixed('observed_at', 'observed_at')}, {plain('p')} AS previous, "
        f"{plain('c')} AS current FROM svc",
        LIFE,
    )
    out["collection_completeness"] = sql(
        "SELECT host_id, snapshot_id, collector_name, status IN ('success', 'partial') AS usable, status = 'success' "
        "AND NOT (collector_name = 'services' AND snapshot_id = 4) AS complete FROM collection_results"
    )
    out["duplicate_identities"] = sql("SELECT host_id, snapshot_id, name, count(*) AS count FROM svc2 GROUP BY ALL HAVING count(*) > 1", SVC2)
    out["service_validity"] = sql(
        "SELECT host_id, snapshot_id, CASE snapshot_id % 5 WHEN 0 THEN '.service' "
        "WHEN 1 THEN name || ' ' ELSE name END AS name, CASE "
        "WHEN snapshot_id % 3 = 0 THEN '' ELSE sub_state END AS sub_state, snapshot_id % 5 > 1 "
        "AND snapshot_id % 3 <> 0 AS valid FROM service_observations"
    )
    out["incident_anchors"] = sql(f"SELECT host_id, snapshot_id, name, lifecycle, {fixed('observed_at', 'observed_at')} FROM anchors", CORR)
    out["dedup_service_changes"] = sql(
        f"SELECT s.host_id, 'service:' || "
        f"{digest(chr(39) + 'service-change-v1' + chr(39), 'name', iso('observed_at'), 'lifecycle', plain('p'), plain('c'))} "
        f"AS change_id, name, {fixed('observed_at', 'observed_at')}, CASE "
        f"WHEN r.status = 'success' THEN '' ELSE 'services_collection_' || r.status END AS limitations FROM svc s "
        f"JOIN collection_results r ON r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id "
        f"AND r.collector_name = 'services' WHERE r.status = 'success' OR s.snapshot_id % 2 = 1",
        LIFE,
    )
    out["dedup_process_changes"] = sql(
        f"SELECT host_id, lifetime_id, {fixed('observed_at', 'observed_at')}, lifecycle FROM prc WHERE lifetime_id IS NOT NULL", LIFE
    )
    out["dedup_events"] = sql(f"SELECT host_id, cursor, {fixed('observed_at', 'observed_at')}, unit, priority FROM journal_events WHERE event_id % 10 <> 0")
    out["service_associations"] = sql("SELECT DISTINCT host_id, service_name, lifetime_id FROM associations")
    out["event_evidence_join"] = sql(
        f"SELECT host_id, name, {fixed('observed_at', 'observed_at')}, evidence_id, {fixed('evidence_at', 'evidence_at')}, "
        f"summary FROM near_events",
        CORR,
    )
    out["process_evidence_join"] = sql(
        f"SELECT host_id, name, {fixed('observed_at', 'observed_at')}, evidence_id, {fixed('evidence_at', 'evidence_at')}, "
        f"summary, fact FROM near_processes",
        CORR,
    )
    out["evidence_topk"] = sql(
        f"SELECT host_id, name, {fixed('observed_at', 'observed_at')}, evidence_id, CAST(k AS INT) AS place "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY host_id, change_id "
        f"ORDER BY abs(epoch_us(evidence_at) - epoch_us(observed_at)), evidence_at, evidence_id) AS k FROM near_events) "
        f"WHERE k < MOST",
        CORR,
    )
    out["evidence_rows"] = sql(
        f"SELECT host_id, incident_id, kind, evidence_id, {fixed('evidence_at', 'evidence_at')}, reason, summary, fact, "
        f"coalesce(e_limit, '') AS evidence_limitations FROM evidence",
        CORR,
    )
    out["incident_candidates"] = sql(
        f"SELECT host_id, incident_id, 'service-condition-v1' AS rule_id, subject_id, 'active' AS state, "
        f"{fixed('started_at', 'started_at')}, {fixed('last_observed_at', 'last_observed_at')}, {LIMS}, n_evidence "
        f"FROM candidates",
        CORR,
    )
    out["resolution_subjects"] = sql("SELECT * FROM back", CORR)
    out["quality_aware_changes"] = sql(
        "SELECT s.host_id, s.snapshot_id, name, lifecycle, CASE "
        "WHEN r.status = 'success' THEN '' ELSE 'services_collection_' || r.status END AS limitations FROM svc s "
        "JOIN collection_results r ON r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id "
        "AND r.collector_name = 'services'",
        LIFE,
    )
    out["incident_formation"] = sql(
        f"SELECT host_id, incident_id, subject_id, state, change, {fixed('last_observed_at', 'last_observed_at')} FROM resolved", CORR
    )
    out["reconcile_unique"] = sql(
        "SELECT host_id, incident_id, CASE WHEN subject_id LIKE 'svc-2%' THEN 'unequal_duplicates' ELSE 'clean' END AS "
        "outcome FROM candidates",
        CORR,
    )
    out["reconcile_upsert"] = sql(
        f"""SELECT host_id, incident_id, CASE WHEN bad THEN 'kept' ELSE change END AS change,
          CASE WHEN o.subject_id LIKE 'svc-4%' THEN 'resolved' ELSE 'active' END AS state, {fixed('last', 'last_observed_at')} FROM overlay
          UNION ALL SELECT host_id, incident_id, change, NULL, NULL FROM overlay WHERE bad""",
        CORR,
        """
overlay AS (
  SELECT host_id, incident_id, o, change IN ('identity_reused', 'evidence_after_resolution') AS bad, change, CASE
    WHEN o IS NULL OR change = 'extended' THEN n.last_observed_at WHEN o.subject_id LIKE 'svc-1%' THEN o.started_at ELSE o.last_observed_at END AS last
  FROM (
    SELECT host_id, incident_id, o, n, CASE WHEN o IS NULL THEN 'inserted' WHEN n IS NULL THEN 'stored' WHEN o.subject_id LIKE 'svc-3%' THEN 'identity_reused'
      WHEN o.subject_id LIKE 'svc-4%' THEN CASE WHEN n.last_observed_at > o.started_at THEN 'evidence_after_resolution' ELSE 'kept' END
      WHEN o.subject_id LIKE 'svc-1%' AND n.last_observed_at > o.started_at THEN 'extended' ELSE 'kept' END AS change
    FROM (SELECT host_id, incident_id, old_half AS o FROM old_half) FULL JOIN (SELECT host_id, incident_id, new_half AS n FROM new_half)
      USING (host_id, incident_id)))""",
    )
    out["reconcile_evidence"] = sql(
        "SELECT host_id, incident_id, kind, evidence_id, CASE WHEN evidence_id LIKE '%7' AND kind = 'journal_event' THEN 'unknown' ELSE fact END AS outcome, "
        "coalesce(e_limit, '') AS evidence_limitations FROM evidence UNION ALL "
        "SELECT host_id, incident_id, kind, evidence_id, 'content_differs', NULL FROM evidence WHERE evidence_id LIKE '%7'",
        CORR,
    )
    out["evidence_cap"] = sql(
        "SELECT host_id, incident_id, evidence_id, n > 3 AS truncated "
        "FROM (SELECT *, count(*) OVER (PARTITION BY host_id, incident_id) AS n, row_number() OVER (PARTITION BY host_id, "
        "incident_id, reason <> 'service_change_anchor' ORDER BY evidence_at DESC, kind DESC, evidence_id DESC) AS k "
        "FROM evidence) WHERE reason = 'service_change_anchor' OR k <= 2 OR n <= 3",
        CORR,
        most=6,
    )
    out["merge_limitations"] = sql(
        "SELECT host_id, user_id, array_to_string(CASE "
        "WHEN len(u) <= 32 THEN u ELSE list_sort(list_append(u[1:31], 'quality_limitations_storage_limit_reached')) END, "
        "'|') AS limitations FROM (SELECT host_id, user_id, list_sort(list_distinct(list_concat(list('a' || event_id % 60), "
        "list('b' || event_id % 7)))) AS u FROM ev GROUP BY host_id, user_id)"
    )
    out["reconcile_resolve"] = sql(
        f"SELECT host_id, incident_id, state, {fixed('last_observed_at', 'last_observed_at')}, now_resolved, problem FROM resolved", CORR
    )
    out["reconcile_result"] = sql(
        "SELECT host_id, incident_id, 'reconciled' AS outcome FROM new_half UNION ALL "
        "SELECT host_id, incident_id, 'resolved' FROM resolved WHERE now_resolved",
        CORR,
    )
    out["diagnose"] = sql(f"SELECT host_id, incident_id, {D_STATE}, rule, {D_FACTS} FROM diag", CORR, DIAG)
    out["incident_history"] = sql("SELECT host_id, incident_id, array_to_string(history, '|') AS history FROM hist", CORR, past(20))
    out["diagnosis_explanation"] = sql(f"SELECT host_id, incident_id, {D_TEXT} FROM diag", CORR, DIAG)
    out["diagnosis_limitations"] = sql("SELECT host_id, incident_id, array_to_string(lim, '|') AS limitations FROM diag", CORR, DIAG)
    out["diagnosis_provenance"] = sql("SELECT host_id, incident_id, array_to_string(ids, '|') AS evidence_ids FROM diag", CORR, DIAG)
    out["inspection_facts"] = sql(
        f"SELECT host_id, incident_id, coalesce(string_agg(DISTINCT fact, '|' "
        f"ORDER BY fact) FILTER (WHERE evidence_id NOT LIKE '%3'), '') AS established, coalesce(string_agg(evidence_id, '|' "
        f"ORDER BY evidence_id) FILTER (WHERE evidence_id LIKE '%3'), '') AS unknown_ids, "
        f"'causal_direction|current_system_state|exact_root_cause' AS not_established FROM evidence "
        f"GROUP BY host_id, incident_id",
        CORR,
    )
    out["report_incidents"] = sql(
        "SELECT CAST(row_number() OVER (ORDER BY last_observed_at DESC, incident_id) - 1 AS INT) AS pos, incident_id, "
        "state, CAST(count(*) OVER () AS INT) AS count, count(*) OVER () = 25 AS limit_reached FROM (SELECT * FROM resolved "
        "ORDER BY last_observed_at DESC, incident_id LIMIT 25)",
        CORR,
    )
    counted = {"n_services": "service_observations", "n_processes": "process_observations", "n_network": "network_observations"}
    counts = ", ".join(f"{number_of(table)} AS {name}" for name, table in (counted | {"events_processed": "journal_events"}).items())
    out["cycle_summary"] = sql(
        f"""SELECT s.host_id, s.snapshot_id, {fixed('observed_at', 'observed_at')}, {CYCLE_LIMITS}, {counts},
          (SELECT CAST(count(*) AS INT) FROM candidates c WHERE c.host_id = s.host_id AND c.started_at = s.observed_at) AS n_candidates,
          (SELECT CAST(count(*) AS INT) FROM resolved c WHERE now_resolved AND c.host_id = s.host_id AND c.resolved_at = s.observed_at)
            AS n_resolved FROM snapshots s""",
        CORR,
    )
    out["snapshot_comparison"] = sql(
        "SELECT s.host_id, s.snapshot_id, c.state AS cpu_state, CASE WHEN c.state = 'valid' THEN c.total END AS total, "
        + ", ".join(
            (
                listed("net", "interface || '/' || receive_bytes_state || '/' || transmit_bytes_state", "interface", "network"),
                listed("net_gone", "interface", "interface", "removed_interfaces"),
                listed("prc_rate", "pid || '/' || coalesce(lifetime_id, '-') || '/' || state", "pid, lifetime_id NULLS FIRST", "processes"),
                listed("prc_left", "lifetime_id", "lifetime_id", "removed_lifetimes"),
            )
        )
        + " FROM snapshots s LEFT JOIN cpus c USING (host_id, snapshot_id)",
        LIFE,
        CPU,
        f"net AS ({rates('network_observations', 'interface', 'receive_bytes', 'transmit_bytes')})",
        f"net_gone AS ({gone('network_observations', 'interface')})",
        f"prc_left AS ({gone('process_observations', 'lifetime_id')})",
        f"prc_rate AS ({PROCESS_RATES})",
    )
    out["inspect_all"] = sql(
        f"""SELECT c.host_id, c.incident_id, {iso('c.started_at')} AS opened_at, 'active' AS state, d.rule, CAST(c.n_evidence AS INT) AS n_evidence,
          (SELECT string_agg(DISTINCT fact, '|' ORDER BY fact) FROM evidence e WHERE e.host_id = c.host_id AND e.incident_id = c.incident_id) AS established, CAST(0 AS INT) AS n_unknown FROM candidates c JOIN diag d USING (host_id, incident_id)""",
        CORR,
        DIAG,
    )
    out["report_inspection"] = sql(
        f"""SELECT c.host_id, c.incident_id, CAST(NULL AS VARCHAR) AS resolved_at,
          (SELECT string_agg(evidence_id || ' ' || reason || ' ' || {iso('evidence_at')}, '|' ORDER BY evidence_at, kind, evidence_id)
            FROM evidence e WHERE e.host_id = c.host_id AND e.incident_id = c.incident_id) AS evidence,
          coalesce(array_to_string(history, '|'), '') AS history FROM candidates c LEFT JOIN hist h USING (host_id, incident_id)""",
        CORR,
        DIAG,
    )
    out["report_diagnosis"] = sql(
        f"""SELECT d.host_id, d.incident_id, d.subject_id, {D_STATE}, rule, {D_TEXT}, {D_FACTS}, array_to_string(ids, '|') AS evidence_ids,
          coalesce(array_to_string(history, '|'), '') AS history, array_to_string(lim, '|') AS limitations,
          'causal_direction|exact_root_cause' AS not_established FROM diag d LEFT JOIN hist h USING (host_id, incident_id)""",
        CORR,
        DIAG,
    )
    out["report_status"] = sql(
        f"""SELECT s.host_id, s.snapshot_id, {iso('s.observed_at')} AS timestamp, CASE
          WHEN {ok17} THEN snapshot_id + 0.25::DOUBLE END AS uptime_seconds, CASE WHEN {ok17} THEN CAST(64000000 AS BIGINT) * 1024 END AS total_bytes,
          (SELECT user_ticks FROM cpu_observations o WHERE o.host_id = s.host_id AND o.snapshot_id = s.snapshot_id) AS user_ticks, """
        + ", ".join(
            (
                listed("process_observations", "concat_ws('/', pid, lifetime_id)", "pid", "processes"),
                listed("disk_observations", "path || '/' || available_blocks * 4096", "path", "disk"),
                listed("network_observations", "interface || '/' || receive_bytes", "interface", "network"),
                listed("service_observations", "name || '/' || active_state", "name", "services"),
                listed("collection_results", "collector_name || '/' || status", "collector_name", "collector_statuses"),
            )
        )
        + f", {iso('s.observed_at')} AS collected_at, CAST(0 AS INT) AS n_warnings FROM snapshots s"
    )
    out["report_cycle"] = sql(
        f"""SELECT s.host_id, s.snapshot_id AS number, {iso('s.observed_at')} AS observed_at, CAST(NULL AS DOUBLE) AS duration_seconds, s.snapshot_id,
          (SELECT string_agg(collector_name || '=' || status, '|' ORDER BY collector_name) FROM collection_results r WHERE r.host_id = s.host_id
            AND r.snapshot_id = s.snapshot_id AND collector_name <> 'journal') AS collection_quality,
          'network=' || {number_of('network_observations')} || '|processes=' || {number_of('process_observations')} || '|services=' ||
            {number_of('service_observations')} AS observation_counts,
          (SELECT status FROM collection_results r WHERE r.host_id = s.host_id AND r.snapshot_id = s.snapshot_id
            AND collector_name = 'journal') AS journal_status, {number_of('journal_events')} AS events_processed,
          (SELECT count(DISTINCT evidence_id) FROM near_events e WHERE e.host_id = s.host_id
            AND e.observed_at = s.observed_at) AS events_correlated, ids AS incident_candidate_ids, ids AS reconciled_candidate_ids,
          (SELECT coalesce(string_agg(incident_id, '|' ORDER BY incident_id), '') FROM resolved c WHERE now_resolved AND c.host_id = s.host_id
            AND c.resolved_at = s.observed_at) AS resolved_incident_ids, {CYCLE_LIMITS}
          FROM (SELECT *, (SELECT coalesce(string_agg(incident_id, '|' ORDER BY incident_id), '') FROM candidates c WHERE c.host_id = z.host_id AND c.started_at = z.observed_at) AS ids FROM snapshots z) s""",
        CORR,
    )
    out["retain_events_cutoff"] = sql("SELECT host_id, cursor FROM journal_events WHERE observed_at >= TIMESTAMP '2024-01-15 12:00:00'")
    out["retain_events_newest"] = sql(
        "SELECT host_id, cursor FROM (SELECT *, row_number() OVER (PARTITION BY host_id "
        "ORDER BY observed_at DESC, cursor DESC) AS k FROM journal_events) WHERE k <= 100"
    )
    out["retain_snapshots_newest"] = sql(
        "SELECT host_id, snapshot_id, name FROM service_observations o WHERE snapshot_id > (SELECT max(snapshot_id) - 9 "
        "FROM snapshots s WHERE s.host_id = o.host_id)"
    )
    out["retain_snapshots_cutoff"] = sql(
        "SELECT host_id, snapshot_id, pid FROM process_observations JOIN snapshots USING (host_id, snapshot_id) "
        "WHERE observed_at >= TIMESTAMP '2024-01-12'"
    )
    out["retain_incidents"] = sql(
        "SELECT host_id, incident_id, state FROM resolved WHERE NOT (state = 'resolved' AND resolved_at < TIMESTAMP '2024-01-22')", CORR
    )
    out["redact_text"] = "SELECT doc_id, substr('--token [REDACTED] url?api_key=[REDACTED] -p [REDACTED] ' || " + redact_duck(
        "coalesce(text, '')"
    ) + ", 1, 200) AS redacted FROM documents"
    out[
        "truncate_utf8"
    ] = "SELECT doc_id, CASE WHEN octet_length(encode(t)) <= 301 THEN t ELSE substr(t, 1, len(list_filter(range(1, " "length(substr(t, 1, 301)) + 1), lambda k: octet_length(encode(substr(t, 1, k))) <= 301))) END AS cut " "FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    out[
        "normalize_fields"
    ] = "SELECT conv_id, turn, CASE WHEN octet_length(encode(t)) <= 120 THEN t ELSE substr(t, 1, len(list_filter(range(1, " "121), lambda k: octet_length(encode(substr(t, 1, k))) <= 120 " "AND k <= length(t)))) END AS value, 'message_redacted' || CASE " "WHEN octet_length(encode(t)) > 120 THEN '|message_truncated' ELSE '' END AS warnings " "FROM (SELECT conv_id, turn, 'secret=[REDACTED] ' || " + redact_duck(
        "coalesce(text, '')"
    ) + " AS t FROM conversations)"
    out["evidence_digest"] = sql(
        "SELECT event_id, " + digest("'event-v1'", "unit", "CASE WHEN event_id % 3 > 0 THEN event_type ELSE '' END", "cursor") + " AS digest FROM ev"
    )
    out["incident_ids"] = sql(
        "SELECT host_id, change_id, " + digest("'incident-v1'", "'service-condition-v1'", "name", "change_id") + " AS incident_id FROM anchors", CORR
    )
    out["iso_timestamp"] = sql(
        f"SELECT event_id, {iso('t')} AS iso, {fixed('ts', 'fixed')} FROM (SELECT *, make_timestamp(epoch_us(ts) + CASE "
        f"WHEN event_id % 2 = 0 THEN event_id ELSE 0 END) AS t FROM ev)"
    )
    out["epoch_micros"] = sql("SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id + 1700000000000000 END AS us FROM ev")
    out["optional_int"] = sql(
        "SELECT event_id, CASE WHEN event_id % 5 > 1 "
        "AND event_id <= 5000 THEN event_id END AS value, event_id % 5 = 0 OR event_id % 5 > 1 AND event_id <= 5000 AS ok "
        "FROM ev"
    )
    out["decode_bytes_field"] = sql("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'hé' WHEN 3 THEN '' END AS decoded FROM ev")
    out["bounded_list"] = sql(
        "SELECT host_id, user_id, array_to_string(CASE "
        "WHEN len(u) <= 32 THEN u ELSE list_sort(list_append(u[1:31], 'quality_limitations_truncated')) END, '|') AS "
        "bounded FROM (SELECT host_id, user_id, list_sort(list_distinct(list('w' || event_id % 90))) AS u FROM ev "
        "GROUP BY host_id, user_id)"
    )
    out["valid_service_name"] = sql("SELECT event_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AS ok FROM ev")
    out["parse_utc"] = sql("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN epoch_us(date_trunc('second', ts)) END AS us FROM ev")
    out["audit_constraints"] = sql(
        "SELECT rule, CAST(v AS BIGINT) AS violations FROM (VALUES "
        + ", ".join(
            f"('{r}', 0)" for r in (
                "snapshot_key",
                "result_key",
                "process_key",
                "network_key",
                "event_key",
                "service_orphans",
                "process_orphans",
                "network_orphans",
                "result_orphans",
                "status_domain",
                "priority_domain",
                "process_domain",
            )
        )
        + ") t(rule, v) UNION ALL SELECT 'counter_domain', count(*) FROM network_observations WHERE receive_bytes < 0 "
        "UNION ALL SELECT 'service_key', count(*) FROM service_observations WHERE snapshot_id = 3"
    )
    out["audit_incidents"] = sql(
        "SELECT rule, CAST(v AS BIGINT) AS violations FROM (VALUES "
        + ", ".join(
            f"('{r}', 0)" for r in (
                "one_anchor",
                "starts_at_anchor",
                "two_kinds",
                "evidence_bound",
                "unique_evidence",
                "resolved_in_order",
                "resolved_state",
                "id_shape",
                "limitations_sorted",
                "limitations_bound",
                "kind_reason_fact",
                "summary_bound",
            )
        )
        + ") t(rule, v) UNION ALL SELECT 'no_later_evidence', count(*) FROM candidates WHERE subject_id LIKE 'svc-1%' "
        "AND last_observed_at > started_at",
        CORR,
    )
    out["audit_collections"] = sql(
        "SELECT 'status_known' AS rule, CAST(0 AS BIGINT) AS violations UNION ALL SELECT 'has_time', 0 UNION ALL "
        "SELECT 'duration_positive', count(*) FROM collection_results WHERE snapshot_id % 4 = 0 OR snapshot_id < 3"
    )
    whole = ("history_bound", "history_unique", "provenance", "facts", "explanation", "limits_bound", "counts_positive", "cycle_limits_sorted")
    whole += ("cycle_limits_bound", "cycle_ids_unique", "cycle_ids_shape", "cycle_number")
    broken = {"cycle_time_order": "snapshot_id % 9 = 0", "cycle_duration": "snapshot_id % 4 = 0 AND snapshot_id % 9 <> 0", "cycle_time_finite": "snapshot_id % 13 = 0"}
    out["audit_reports"] = sql(
        "SELECT rule, CAST(0 AS BIGINT) AS violations FROM (VALUES "
        + ", ".join(f"('{r}')" for r in whole)
        + ") t(rule)"
        + "".join(f" UNION ALL SELECT '{r}', count(*) FROM snapshots WHERE {w}" for r, w in broken.items())
    )
    out["upgrade_history"] = sql(
        "SELECT event_id, strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%S') || CASE "
        "WHEN event_id % 2 = 0 THEN '.500000' ELSE '.000000' END || '+00:00' AS observed_text, CASE "
        "WHEN event_id % 3 = 0 THEN 'w' ELSE 'legacy_quality_unknown' END AS warnings FROM ev"
    )
    return out


def redact_duck(c: str) -> str:
    name = "token|password|passwd|secret|api[_-]?key|authorization"
    for pattern, put in (
        (f"({name})(=|:)([^\\s]+)", "\\1\\2"),
        (f"(--?(?:{name})\\b)(\\s+)([^\\s]+)", "\\1\\2"),
        ("(^|\\s)(-[pk])(\\s+)([^\\s]+)", "\\1\\2\\3"),
        (f"([?&](?:{name})=)([^&\\s]+)", "\\1"),
    ):
        c = f"regexp_replace({c}, '(?i){pattern}', '{put}[REDACTED]', 'g')"
    return c
