"""The same queries as plain SQL. Common table expressions are named once here; `sql` puts the ones
a query mentions, directly or through others, in front of it."""

import re

# Fixed values, stated apart from the code under test.
DB_PORTS = (3306, 5432, 1433, 1521, 27017, 6379)
SENSITIVE_PORTS = (22, 3389, 445)
ADMIN_PORTS = (22, 3389, 445, 135, 5985, 5986)
LATERAL_TOOLS = ("psexec", "wmic", "winrm", "dcom", "mimikatz", "cobalt")
TACTICS = (
    ("psexec", ("TA0008 Lateral Movement", "T1021.002 SMB/Windows Admin Shares")),
    ("ssh", ("TA0008 Lateral Movement", "T1021.004 SSH")),
    ("rdp", ("TA0008 Lateral Movement", "T1021.001 Remote Desktop Protocol")),
    ("wmic", ("TA0008 Lateral Movement", "T1047 Windows Management Instrumentation")),
    ("powershell", ("TA0002 Execution", "T1059.001 PowerShell")),
    ("authentication", ("TA0006 Credential Access", "T1078 Valid Accounts")),
    ("file_access", ("TA0009 Collection", "T1005 Data from Local System")),
    ("dns", ("TA0011 Command and Control", "T1071.004 DNS")),
)
DEFAULT_TACTICS = ("TA0008 Lateral Movement", "T1021 Remote Services")
PASSES = 4

_ADMIN = ", ".join(map(str, ADMIN_PORTS))
_DB = ", ".join(map(str, DB_PORTS))
_HIGH = ", ".join(map(str, SENSITIVE_PORTS))
_TOOLS = "|".join(LATERAL_TOOLS)

CTES: dict[str, str] = {}

CTES["ev"] = r"""
SELECT CAST(event_id AS VARCHAR) AS event_id, ts, user_id AS u, event_type AS et, value,
       CAST(regexp_extract(props, '(\d+)', 1) AS INTEGER) AS k
FROM events"""
CTES["tel"] = """
SELECT event_id, ts,
  CASE WHEN et IN ('signup','view') THEN 'usr-' ELSE 'wl-' END || u AS source_node,
  CASE et WHEN 'view' THEN 'wl-' || (u % 100) WHEN 'purchase' THEN 'db-' || (k % 10) ELSE 'wl-' || k END AS destination_node,
  '10.0.0.' || (u % 250) AS source_ip, '10.1.0.' || k AS destination_ip,
  CASE et WHEN 'signup' THEN 'authentication' WHEN 'view' THEN 'application' WHEN 'error' THEN 'process_exec'
       ELSE 'network_flow' END AS event_type,
  CASE et WHEN 'view' THEN 'UDP' ELSE 'TCP' END AS protocol,
  CASE et WHEN 'purchase' THEN 5432 WHEN 'error' THEN [22, 3389, 445, 135][k % 4 + 1] ELSE 443 END AS port,
  CAST(trunc(value * 1000) AS BIGINT) AS bytes_transferred,
  'usr-' || u AS "user",
  CASE et WHEN 'purchase' THEN 'postgres'
       WHEN 'error' THEN ['psexec','ssh','rdp','wmi','winrm','dcom','powershell'][k % 7 + 1] ELSE 'chrome' END AS process,
  et <> 'error' AS success
FROM ev"""
CTES["latest"] = "SELECT max(ts) AS t FROM events"
CTES["raw"] = r"""
SELECT event_id, 'network_flow' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
       '10.0.0.' || u AS src_ip, '10.1.0.' || k AS dst_ip,
       CASE WHEN k % 18 = 9 THEN 'n/a' WHEN k % 18 = 0 THEN ' 5432 ' ELSE CAST(k + 20 AS VARCHAR) END AS dst_port,
       CAST(CAST(trunc(value * 1000) AS BIGINT) AS VARCHAR) AS bytes, 'tcp' AS protocol
FROM ev WHERE k % 9 = 0
UNION ALL BY NAME
SELECT event_id, 'process_exec' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp,
       'wl-' || u AS src_host, 'wl-' || k AS dst_host, 'PsExec' AS process_name, 'usr-' || u AS username
FROM ev WHERE k % 9 = 1
UNION ALL BY NAME
SELECT event_id, 'cloud_audit' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
       'usr-' || u AS source_id, 'db-' || (k % 10) AS dest_id, 'usr-' || u AS "user",
       CASE WHEN et = 'error' THEN 'False' ELSE 'ok' END AS result
FROM ev WHERE k % 9 = 2
UNION ALL BY NAME
SELECT event_id, 'container' AS event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       'wl-' || u AS src_node, CASE WHEN k % 2 = 0 THEN 'wl-' || k ELSE '' END AS dst_node, 'Bash' AS process
FROM ev WHERE k % 9 = 3
UNION ALL BY NAME
SELECT event_id, 'authentication' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp,
       'usr-' || u AS source_node, 'wl-' || k AS destination_node, CASE WHEN k % 2 = 0 THEN 'true' ELSE '0' END AS success
FROM ev WHERE k % 9 = 4
UNION ALL BY NAME
SELECT event_id, 'application' AS event_type, 'yesterday' AS timestamp, 'wl-' || u AS source_node,
       'wl-' || k AS destination_node, CAST(CAST(trunc(value * 1000) AS BIGINT) AS VARCHAR) AS bytes_transferred, 'udp' AS protocol
FROM ev WHERE k % 9 = 5
UNION ALL BY NAME
SELECT event_id, 'dns' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, '' AS source_node,
       'wl-' || u AS src_host, 'resolver' AS dst_host, '53' AS port,
       CASE WHEN k % 4 = 0 THEN '12.5' ELSE CAST(CAST(trunc(value * 1000) AS BIGINT) AS VARCHAR) END AS bytes
FROM ev WHERE k % 9 = 6
UNION ALL BY NAME
SELECT event_id, 'vpn' AS event_type, '172.16.0.1' AS source_ip, '172.16.0.2' AS src_ip, '10.2.0.1' AS destination_ip,
       'usr-' || u AS "user", strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, '' AS success
FROM ev WHERE k % 9 = 7
UNION ALL BY NAME
SELECT event_id, 'file_access' AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS timestamp, 'wl-' || u AS src_node,
       'usr-' || u AS source_id, 'db-files' AS dst_node, 'CMD' AS process_name, '445' AS port
FROM ev WHERE k % 9 = 8"""
CTES["typed"] = r"""
SELECT event_id,
  coalesce(
    CASE WHEN regexp_full_match(timestamp, '\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(\.\d{1,6})?Z')
           THEN try_cast(replace(replace(timestamp, 'T', ' '), 'Z', '') AS TIMESTAMP)
         WHEN regexp_full_match(timestamp, '\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}') THEN try_cast(timestamp AS TIMESTAMP)
         WHEN regexp_full_match(timestamp, '-?\d+') THEN make_timestamp(CAST(timestamp AS BIGINT) * 1000000) END,
    (SELECT t FROM latest)) AS ts,
  coalesce(nullif(source_node,''), nullif(src_node,''), nullif(source_id,''), nullif(src_host,''), nullif(src_ip,''), 'unknown-source') AS source_node,
  coalesce(nullif(destination_node,''), nullif(dst_node,''), nullif(dest_id,''), nullif(dst_host,''), nullif(dst_ip,''), 'unknown-destination') AS destination_node,
  coalesce(source_ip, src_ip, '') AS source_ip, coalesce(destination_ip, dst_ip, '') AS destination_ip, event_type,
  upper(coalesce(protocol, 'TCP')) AS protocol,
  coalesce(port, dst_port) AS port_text, coalesce(bytes_transferred, bytes) AS bytes_text,
  CASE WHEN regexp_full_match(trim(port_text), '[+-]?\d+') THEN try_cast(trim(port_text) AS INTEGER) END AS port_value,
  CASE WHEN regexp_full_match(trim(bytes_text), '[+-]?\d+') THEN try_cast(trim(bytes_text) AS BIGINT) END AS bytes_value,
  coalesce("user", username, '') AS "user", lower(coalesce(process, process_name, '')) AS process,
  coalesce(lower(coalesce(success, result)) NOT IN ('false','f','no','n','0','0.0',''), true) AS success,
  CASE WHEN port_text IS NOT NULL AND port_value IS NULL THEN 'port'
       WHEN bytes_text IS NOT NULL AND bytes_value IS NULL THEN 'bytes_transferred' END AS reject_reason
FROM raw"""
CTES["good"] = """
SELECT event_id, ts, source_node, destination_node, source_ip, destination_ip, event_type, protocol,
  coalesce(port_value, 0) AS port, coalesce(bytes_value, 0) AS bytes_transferred, "user", process, success
FROM typed WHERE reject_reason IS NULL"""


def _ends(port: str) -> str:
    return f"""
SELECT event_id, ts, bytes_transferred, source_node = destination_node AS self_loop, 0 AS role, source_node AS node_id,
  CASE WHEN source_node LIKE 'db-%' THEN 'asset' WHEN source_node LIKE 'usr-%' THEN 'user' ELSE 'workload' END AS node_type,
  CASE WHEN source_node LIKE 'db-%' THEN 4 ELSE 1 END AS sensitivity, source_ip AS ip_address,
  source_node LIKE 'db-%' AS is_critical
FROM tel
UNION ALL
SELECT event_id, ts, bytes_transferred, source_node = destination_node, 1, destination_node,
  CASE WHEN destination_node LIKE 'db-%' OR {port} IN ({_DB}) THEN 'asset'
       WHEN destination_node LIKE 'usr-%' THEN 'user' ELSE 'workload' END,
  CASE WHEN destination_node LIKE 'db-%' OR {port} IN ({_DB}) THEN 4 WHEN {port} IN ({_HIGH}) THEN 3 ELSE 1 END,
  destination_ip, destination_node LIKE 'db-%' OR {port} IN ({_DB})
FROM tel"""


_NODES = """
SELECT node_id, arg_min(node_type, (ts, role)) AS node_type, max(sensitivity) AS sensitivity,
  max(sensitivity) = 4 AS is_critical, arg_min(ip_address, (ts, role)) AS ip_address,
  CAST(sum(CASE WHEN self_loop THEN 0 ELSE 1 END) AS BIGINT) AS event_count,
  min(ts) FILTER (sensitivity >= 3) AS since_3, min(ts) FILTER (sensitivity >= 4) AS since_4
FROM {ends} GROUP BY node_id"""
CTES["ends"] = _ends("port")
CTES["ends_prefix"] = _ends("0")
CTES["nodes"] = _NODES.format(ends="ends")
CTES["nodes_prefix"] = _NODES.format(ends="ends_prefix")


def _fold(where: str = "true") -> str:
    return f"""
SELECT source_node AS src, destination_node AS dst, count(*) AS event_count,
  CAST(sum(bytes_transferred) AS BIGINT) AS bytes_total, min(ts) AS first_seen, max(ts) AS last_seen,
  list_sort(list_distinct(list(protocol))) AS protocols,
  bool_or(regexp_matches(process, '{_TOOLS}')) AS lateral_tool,
  min(port) FILTER (port IN ({_ADMIN})) AS admin_port
FROM tel WHERE source_node <> destination_node AND {where} GROUP BY 1, 2"""


CTES["edges"] = _fold()
_EDGE = """src, dst, event_count, bytes_total, first_seen, last_seen, array_to_string(protocols, ',') AS protocols"""


def _trailing(keys: str, source: str, std: bool = False) -> str:
    out = []
    for name, span, minutes in (("current", "5 minutes", 5), ("short", "24 hours", 1440), ("long", "7 days", 10080)):
        hit = f"FILTER (ts >= last_at - INTERVAL {span})"
        out += [
            f"count(*) {hit} AS {name}_count", f"{name}_count / {minutes}.0::DOUBLE AS {name}_rate",
            f"avg(bytes_transferred) {hit} AS {name}_mean",
        ]
        if std:
            out.append(f"coalesce(stddev_samp(bytes_transferred) {hit}, 0) AS {name}_std")
    return f"""
SELECT {keys}, {', '.join(out)}
FROM (SELECT *, max(ts) OVER (PARTITION BY {keys}) AS last_at FROM {source}) GROUP BY {keys}"""


CTES["flows"] = "SELECT source_node AS src, destination_node AS dst, * FROM tel"
CTES["pw"] = _trailing("src, dst", "flows")
CTES["nw"] = _trailing("node_id", "ends", std=True)
CTES["gap"] = """
SELECT src, dst, least(1.0, abs(current_count / 5.0 - short_count / 1440.0) / (short_count / 1440.0))::DOUBLE AS deviation FROM pw"""
CTES["weighted"] = """
SELECT *, 0.4::DOUBLE * frequency_score + 0.3::DOUBLE * sensitivity_score + 0.3::DOUBLE * deviation_score AS weight FROM (
  SELECT e.*, e.event_count::DOUBLE / max(e.event_count) OVER (PARTITION BY e.src) AS frequency_score,
    (CASE WHEN n.since_4 <= e.last_seen THEN 4 WHEN n.since_3 <= e.last_seen THEN 3 ELSE 1 END) / 4.0::DOUBLE AS sensitivity_score,
    g.deviation AS deviation_score
  FROM edges e JOIN nodes n ON n.node_id = e.dst JOIN gap g ON g.src = e.src AND g.dst = e.dst)"""
CTES["pit"] = """
SELECT src, dst, arg_max(own::DOUBLE / peak, ts) AS frequency_score FROM (
  SELECT *, max(own) OVER (PARTITION BY src ORDER BY ts ROWS UNBOUNDED PRECEDING) AS peak FROM (
    SELECT src, dst, ts, row_number() OVER (PARTITION BY src, dst ORDER BY ts) AS own FROM flows WHERE src <> dst))
GROUP BY src, dst"""
CTES["live"] = "SELECT * FROM weighted WHERE last_seen >= (SELECT t FROM latest) - INTERVAL 7 DAYS"
_DECAY = "weight * exp(-0.1 * greatest(0, (epoch_us((SELECT t FROM latest)) - epoch_us(last_seen)) / 3600000000.0))"
CTES["decayed"] = f"SELECT * REPLACE ({_DECAY} AS weight) FROM live"

# -- features and embeddings
CTES["behave"] = """
SELECT n.node_id, coalesce(o.c, 0)::DOUBLE AS out_degree, coalesce(i.c, 0)::DOUBLE AS in_degree,
  coalesce(o.c, 0)::DOUBLE AS peers_out, coalesce(i.c, 0)::DOUBLE AS peers_in,
  coalesce(o.mx, 0)::DOUBLE AS max_out_weight, coalesce(o.av, 0)::DOUBLE AS mean_out_weight,
  coalesce(i.mx, 0)::DOUBLE AS max_in_weight, coalesce(i.av, 0)::DOUBLE AS mean_in_weight,
  coalesce(o.mb, 0)::DOUBLE AS out_megabytes, coalesce(i.mb, 0)::DOUBLE AS in_megabytes,
  coalesce(p.c, 0)::DOUBLE AS protocol_count
FROM nodes n
LEFT JOIN (SELECT src, count(*) c, max(weight) mx, avg(weight) av, sum(bytes_total) / 1e6 mb FROM weighted GROUP BY src) o ON o.src = n.node_id
LEFT JOIN (SELECT dst, count(*) c, max(weight) mx, avg(weight) av, sum(bytes_total) / 1e6 mb FROM weighted GROUP BY dst) i ON i.dst = n.node_id
LEFT JOIN (SELECT source_node, count(DISTINCT protocol) c FROM tel WHERE source_node <> destination_node GROUP BY 1) p ON p.source_node = n.node_id"""
CTES["und"] = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges"
CTES["deg"] = "SELECT node_id, count(*) AS d FROM (SELECT a AS node_id FROM und UNION ALL SELECT b FROM und) GROUP BY 1"
CTES["tri"] = """
SELECT node_id, count(*) AS c FROM (
  SELECT unnest([x.a, x.b, y.b]) AS node_id FROM und x JOIN und y ON y.a = x.b JOIN und z ON z.a = x.a AND z.b = y.b) GROUP BY 1"""
CTES["clust"] = """
SELECT n.node_id, coalesce(t.c, 0) AS triangles,
  CASE WHEN d.d >= 2 THEN 2.0::DOUBLE * coalesce(t.c, 0) / (d.d * (d.d - 1)) ELSE 0 END AS clustering
FROM nodes n LEFT JOIN deg d USING (node_id) LEFT JOIN tri t USING (node_id)"""
CTES["outdeg"] = "SELECT src, count(*) AS c FROM edges GROUP BY src"
CTES["pr_n"] = "SELECT count(*)::DOUBLE AS n FROM nodes"
CTES["pr_0"] = "SELECT node_id, o.c AS od, 1.0 / (SELECT n FROM pr_n) AS r, 1e9::DOUBLE AS ch FROM nodes LEFT JOIN outdeg o ON o.src = node_id"
for _i in range(1, 51):
    CTES[f"pr_{_i}"] = f"""
SELECT p.node_id, p.od, q.r, abs(q.r - p.r) AS ch FROM pr_{_i - 1} p JOIN (
  SELECT node_id, 0.85 * (coalesce(f.x, 0) + (SELECT coalesce(sum(r), 0) FROM pr_{_i - 1} WHERE od IS NULL) / (SELECT n FROM pr_n))
         + 0.15 / (SELECT n FROM pr_n) AS r
  FROM pr_{_i - 1} LEFT JOIN (SELECT e.dst, sum(s.r / s.od) AS x FROM edges e JOIN pr_{_i - 1} s ON s.node_id = e.src GROUP BY 1) f ON f.dst = node_id
) q USING (node_id)"""
CTES["pr_all"] = " UNION ALL ".join(f"SELECT {i} AS round, node_id, r, ch FROM pr_{i}" for i in range(1, 51))
CTES["pr_stop"] = """
SELECT min(round) AS round FROM (SELECT round, sum(ch) AS ch FROM pr_all GROUP BY round) WHERE ch < (SELECT n FROM pr_n) * 1e-6"""
CTES["pr"] = """
SELECT node_id, CASE WHEN s.round IS NULL THEN 0 ELSE a.r END AS pagerank, s.round IS NOT NULL AS converged
FROM pr_all a, pr_stop s WHERE a.round = coalesce(s.round, 50)"""
CTES["struct"] = """
SELECT p.node_id, p.pagerank, c.clustering, coalesce(o.c, 0) / (SELECT n FROM pr_n) AS out_share,
  coalesce(i.c, 0) / (SELECT n FROM pr_n) AS in_share
FROM pr p JOIN clust c USING (node_id) LEFT JOIN outdeg o ON o.src = p.node_id
LEFT JOIN (SELECT dst, count(*) c FROM edges GROUP BY 1) i ON i.dst = p.node_id"""


def _clock(ts: str) -> list[str]:
    hour, day = f"hour({ts}) * (2 * pi() / 24)", f"(isodow({ts}) - 1) * (2 * pi() / 7)"
    return [f"sin({hour})", f"cos({hour})", f"sin({day})", f"cos({day})"]


_B = ["out_degree", "in_degree", "peers_out", "peers_in", "max_out_weight", "mean_out_weight", "max_in_weight",
      "mean_in_weight", "out_megabytes", "in_megabytes", "protocol_count"]
_TYPE = ["(n.node_type = 'workload')::INT::DOUBLE", "(n.node_type = 'user')::INT::DOUBLE", "(n.node_type = 'asset')::INT::DOUBLE",
         "n.sensitivity / 4.0", "n.is_critical::INT::DOUBLE"]


def _block(cells: list[str], width: int) -> str:
    return ", ".join([*(f"({c})::DOUBLE" for c in cells), *["0.0::DOUBLE"] * (width - len(cells))])


_T = [f"coalesce(w.{c}, 0)" for c in ("short_count", "short_rate", "short_mean", "short_std")]
CTES["feat"] = f"""
SELECT node_id, unnest(range(64)) AS i, unnest(v) AS x FROM (
  SELECT n.node_id, [{_block([f'b.{c}' for c in _B], 24)}, {_block(_T + _clock('(SELECT t FROM latest)'), 16)},
    {_block(['s.pagerank', 's.clustering', 's.out_share', 's.in_share'], 16)}, {_block(_TYPE, 8)}] AS v
  FROM nodes n JOIN behave b USING (node_id) JOIN struct s USING (node_id) LEFT JOIN nw w USING (node_id))"""


def _layer(prior: str, wide: int, narrow: int, receiver: str, peer: str, act: str, lonely: str) -> str:
    return f"""
SELECT node_id, j AS i, {act} AS x FROM (
  SELECT c.node_id, j.j, sum(c.x * sin(12.9898 * c.i + 78.233 * j.j) * 0.01) AS y FROM (
    SELECT node_id, i, x FROM {prior}
    UNION ALL
    SELECT h.node_id, h.i + {wide}, coalesce(m.x, {lonely}) FROM {prior} h LEFT JOIN (
      SELECT e.{receiver} AS node_id, p.i, avg(p.x) AS x FROM edges e JOIN {prior} p ON p.node_id = e.{peer} GROUP BY 1, 2
    ) m ON m.node_id = h.node_id AND m.i = h.i
  ) c, (SELECT unnest(range({narrow})) AS j) j GROUP BY 1, 2)"""


for _p, _recv, _peer, _acts, _lone in (
    ("so", "src", "dst", ("tanh(y)",) * 3, "h.x"),
    ("si", "dst", "src", ("greatest(y, 0)", "greatest(y, 0)", "y"), "0"),
):
    CTES[f"{_p}_1"] = _layer("feat", 64, 128, _recv, _peer, _acts[0], _lone)
    CTES[f"{_p}_2"] = _layer(f"{_p}_1", 128, 64, _recv, _peer, _acts[1], _lone)
    CTES[f"{_p}_3"] = _layer(f"{_p}_2", 64, 32, _recv, _peer, _acts[2], _lone)

# -- detection


def _age(t: str) -> str:
    return f"((epoch_us({t}) - epoch_us(e.first_seen)) / 3600000000.0)"


def _fresh(t: str, sensitive: str) -> str:
    return f"CASE WHEN {_age(t)} < 1 THEN (CASE WHEN {sensitive} THEN 0.75 ELSE 0.2 END) * (1 - {_age(t)}) ELSE 0 END::DOUBLE"


def _rules(edges: str, t: str, baseline: str | None) -> str:
    sensitive = f"coalesce(d.since_3 <= {t}, false)"
    young, tool = f"{_age(t)} < 1", "e.lateral_tool"
    port = "(e.event_count <= 2 AND e.admin_port IS NOT NULL AND s.node_type <> 'asset')"
    spike = "coalesce(b.baseline > 0 AND g.c > 2.5 * b.baseline, false)"
    join = f"LEFT JOIN (SELECT src, baseline FROM {baseline} WHERE baseline IS NOT NULL) b ON b.src = e.src" if baseline else \
        "LEFT JOIN (SELECT NULL::VARCHAR AS src, NULL::DOUBLE AS baseline) b ON b.src = e.src"
    return f"""
SELECT e.src, e.dst, g.c AS out_degree, NOT ({young}) AND NOT {tool} AND NOT {port} AS reached,
  (CASE WHEN {young} THEN {_fresh(t, sensitive)} WHEN {tool} THEN 0.8 WHEN {port} THEN 0.65 WHEN {spike} THEN 0.6 ELSE 0 END)::DOUBLE AS rule_score,
  CASE WHEN {young} AND {sensitive} THEN 'R1:new_edge_to_sensitive' WHEN {young} THEN 'R1:new_edge'
       WHEN {tool} THEN 'R2:lateral_movement_tool' WHEN {port} THEN 'R3:admin_port_' || e.admin_port
       WHEN {spike} THEN 'R4:degree_spike' ELSE '' END AS rule_triggered
FROM {edges} e JOIN nodes s ON s.node_id = e.src JOIN nodes d ON d.node_id = e.dst
JOIN (SELECT src, count(*) AS c FROM {edges} GROUP BY 1) g ON g.src = e.src {join}"""


_NOW = "(SELECT t FROM latest)"


def _passes(prefix: str, moments: list[str]) -> None:
    """Edges, rule scores and degree baselines at each of the growing moments."""
    for i, when in enumerate(moments):
        prior = f"{prefix}_deg_{i - 1}" if i else None
        CTES[f"{prefix}_edges_{i}"] = _fold(f"ts <= {when}")
        CTES[f"{prefix}_rules_{i}"] = _rules(f"{prefix}_edges_{i}", when, prior)
        known = f"FULL JOIN (SELECT src, baseline AS old FROM {prior} WHERE baseline IS NOT NULL) p USING (src)" if i else \
            "LEFT JOIN (SELECT NULL::VARCHAR AS src, NULL::DOUBLE AS old) p USING (src)"
        CTES[f"{prefix}_deg_{i}"] = f"""
SELECT {i} AS pass, src, degree, m AS edges_reached, spike,
  CASE WHEN m = 0 OR spike THEN old ELSE pow(0.9, m) * start + (1 - pow(0.9, m)) * degree END AS baseline
FROM (SELECT src, degree, old, coalesce(m, 0) AS m, coalesce(old, degree) AS start,
        coalesce(coalesce(old, degree) > 0 AND degree > 2.5 * coalesce(old, degree), false) AS spike
      FROM (SELECT src, max(out_degree)::DOUBLE AS degree, count(*) FILTER (reached) AS m FROM {prefix}_rules_{i} GROUP BY 1) {known})"""


CTES["rules"] = _rules("edges", _NOW, None)
_passes("pass", [f"({_NOW} - INTERVAL {7 * (PASSES - 1 - i)} DAYS)" for i in range(PASSES)])
CTES["marks"] = "SELECT (day(ts) - 1) // 8 AS slice, max(ts) AS t FROM tel GROUP BY 1"
_passes("step", [f"(SELECT max(t) FROM marks WHERE slice <= {i})" for i in range(4)])
CTES["pass_alerts"] = " UNION ALL ".join(
    f"SELECT {_NOW} - INTERVAL {7 * (PASSES - 1 - i)} DAYS AS created_at, count(*) AS total_flagged_edges, "
    f"{'(SELECT coalesce(max(risk_score), 0) FROM paths)' if i == PASSES - 1 else '0'}::DOUBLE AS max_risk_score "
    f"FROM pass_rules_{i} WHERE rule_score > 0.7 HAVING count(*) > 0"
    for i in range(PASSES)
)
_SEV = "CASE WHEN {0} > 0.8 THEN 'CRITICAL' WHEN {0} > 0.5 THEN 'HIGH' WHEN {0} > 0.2 THEN 'MEDIUM' ELSE 'LOW' END"
CTES["alerts"] = f"""
SELECT sha256('alert|' || epoch_us(created_at)) AS alert_id, {_SEV.format('max_risk_score')} AS severity, * FROM pass_alerts"""
CTES["cosd"] = """
SELECT e.src, e.dst, CASE WHEN sum(a.x * a.x) = 0 OR sum(b.x * b.x) = 0 THEN 0
  ELSE (1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x)))) / 2 END AS d_g
FROM edges e JOIN so_3 a ON a.node_id = e.src JOIN so_3 b ON b.node_id = e.dst AND b.i = a.i GROUP BY 1, 2"""
CTES["scores"] = f"""
SELECT *, greatest(gnn_score, rule_score) AS total_score, greatest(gnn_score, rule_score) > 0.7 AS is_flagged FROM (
  SELECT *, 0.5::DOUBLE * d_b + 0.3::DOUBLE * d_t + 0.2::DOUBLE * d_g AS gnn_score FROM (
    SELECT e.src, e.dst, {_fresh(_NOW, 'd.since_3 IS NOT NULL')} AS d_b, g.deviation AS d_t, c.d_g, r.rule_score, r.rule_triggered
    FROM edges e JOIN nodes d ON d.node_id = e.dst JOIN gap g ON g.src = e.src AND g.dst = e.dst
    JOIN cosd c ON c.src = e.src AND c.dst = e.dst JOIN rules r ON r.src = e.src AND r.dst = e.dst))"""
CTES["flagged"] = "SELECT * FROM scores WHERE is_flagged"
CTES["top5"] = "SELECT *, row_number() OVER (ORDER BY total_score DESC, src, dst) AS rn FROM flagged QUALIFY rn <= 5"
CTES["tactic_map"] = " UNION ALL ".join(
    f"SELECT '{kw}' AS kw, {k} AS k, {p} AS p, '{label}' AS tactic"
    for k, (kw, labels) in enumerate(TACTICS) for p, label in enumerate(labels)
)
CTES["tactics"] = f"""
SELECT coalesce(string_agg(tactic, '|' ORDER BY o), '{"|".join(DEFAULT_TACTICS)}') AS tactics FROM (
  SELECT m.tactic, min((f.ts, m.k, m.p)) AS o FROM flows f SEMI JOIN flagged g ON g.src = f.src AND g.dst = f.dst
  JOIN tactic_map m ON contains(f.process, m.kw) OR m.kw = f.event_type GROUP BY 1)"""

# -- paths and containment
CTES["starts"] = """
SELECT DISTINCT src AS node_id FROM top5 WHERE total_score > 0.85 OR (rn = 1 AND (SELECT max(total_score) FROM top5) <= 0.85)"""


def _paths(prefix: str, edges: str) -> None:
    CTES[f"{prefix}_0"] = "SELECT node_id AS start, node_id AS node, 1.0::DOUBLE AS p, [node_id] AS nodes FROM starts"
    for hop in range(1, 6):
        CTES[f"{prefix}_{hop}"] = f"""
SELECT f.start, e.dst AS node, f.p * e.weight AS p, list_append(f.nodes, e.dst) AS nodes
FROM {prefix}_{hop - 1} f JOIN {edges} e ON e.src = f.node
WHERE NOT list_contains(f.nodes, e.dst) AND f.p * e.weight >= 0.001
QUALIFY row_number() OVER (PARTITION BY f.start, e.dst ORDER BY f.p * e.weight DESC, list_append(f.nodes, e.dst)) = 1"""
    union = " UNION ALL ".join(f"SELECT {h} AS hop_count, * FROM {prefix}_{h}" for h in range(1, 6))
    CTES[f"{prefix}_rated"] = f"""
SELECT sha256(array_to_string(f.nodes, '>')) AS path_id, f.start AS source, f.node AS target, f.nodes, f.hop_count,
  f.p AS probability, (CASE n.sensitivity WHEN 4 THEN 1.0 WHEN 3 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END
    + CASE WHEN n.is_critical THEN 0.2 ELSE 0 END)::DOUBLE AS impact_score, f.p * impact_score AS risk_score,
  CASE WHEN risk_score > 0.8 THEN 'AUTO_ISOLATE' WHEN risk_score > 0.5 THEN 'SOC_ALERT' ELSE 'MONITOR' END AS risk_class
FROM ({union}) f JOIN nodes n ON n.node_id = f.node WHERE n.sensitivity >= 3 OR n.is_critical"""


_paths("ap", "live")
_paths("dp", "decayed")
CTES["paths"] = "SELECT * FROM ap_rated"
_PATH = """path_id, source, target, array_to_string(nodes, '>') AS nodes, hop_count, round(probability, 6) AS probability,
  round(impact_score, 6) AS impact_score, round(risk_score, 6) AS risk_score, risk_class"""
CTES["cut"] = """
SELECT DISTINCT risk_class, nodes[i] AS src, nodes[i + 1] AS dst
FROM (SELECT risk_class, nodes, unnest(range(1, len(nodes))) AS i FROM paths WHERE risk_class <> 'MONITOR')"""
CTES["actions"] = f"""
SELECT sha256(risk_class || '|' || epoch_us({_NOW})) AS action_id, risk_class, risk_score, path_count, edge_count, business_impact,
  CASE WHEN risk_class = 'SOC_ALERT' THEN 'SOC_ALERT' WHEN business_impact < 0.05 THEN 'AUTO_ISOLATE'
       WHEN business_impact < 0.2 THEN 'SOC_ALERT' ELSE 'MANUAL_REVIEW' END AS action_type,
  risk_class = 'AUTO_ISOLATE' AND business_impact < 0.05 AS auto_applied, {_NOW} AS created_at,
  CASE WHEN risk_class = 'AUTO_ISOLATE' AND business_impact < 0.05 THEN {_NOW} END AS applied_at
FROM (SELECT risk_class, count(*) AS path_count, max(risk_score) AS risk_score FROM paths WHERE risk_class <> 'MONITOR' GROUP BY 1)
JOIN (SELECT risk_class, count(*) AS edge_count, coalesce(sum(l.weight), 0) / greatest((SELECT sum(weight) FROM live), 1e-9) AS business_impact
      FROM cut c LEFT JOIN live l ON l.src = c.src AND l.dst = c.dst GROUP BY 1) USING (risk_class)"""
CTES["fw"] = """
SELECT sha256(action_id || '|' || source || '|' || destination) AS rule_id, action_id, 'DENY' AS action, source, destination,
  'ANY' AS protocol, 0 AS port, priority, created_at, created_at + INTERVAL 24 HOURS AS expires_at,
  why || format('{:.2f}', risk_score) || ')' AS reason, auto_applied
FROM (SELECT c.risk_class, node_id AS source, 'ANY' AS destination, 10 AS priority, 'Compromised node isolation (risk=' AS why
      FROM starts, (SELECT unnest(['AUTO_ISOLATE', 'SOC_ALERT']) AS risk_class) c
      UNION ALL SELECT risk_class, src, dst, 20, 'Attack path edge block (risk=' FROM cut) JOIN actions USING (risk_class)"""
_RULE = "rule_id, action_id, action, source, destination, protocol, port, priority, created_at, expires_at, reason"
CTES["alert_nodes"] = "SELECT DISTINCT unnest([src, dst]) AS node_id FROM flagged"
CTES["best"] = "SELECT *, row_number() OVER (ORDER BY risk_score DESC, nodes) AS rn FROM paths QUALIFY rn <= 5"
CTES["first_action"] = """
SELECT a.action_type, a.auto_applied, (SELECT count(*) FROM fw f WHERE f.action_id = a.action_id) AS rules_count
FROM actions a ORDER BY risk_class LIMIT 1"""
CTES["alert"] = f"""
SELECT sha256('alert|' || epoch_us({_NOW})) AS alert_id, {_SEV.format('risk')} AS severity,
  '[' || severity || '] Potential Lateral Movement Detected — ' || node_count || ' node(s)' AS title,
  'GNN anomaly detector flagged ' || total_flagged_edges || ' suspicious edges.' || coalesce(' Highest risk path: ' || b.source || ' → '
    || b.target || ' (risk=' || format('{{:.2f}}', risk) || ', hops=' || b.hop_count || ')', '') AS description,
  node_count, total_flagged_edges, total_attack_paths, risk AS max_risk_score, fa.action_type, fa.rules_count,
  concat_ws('|', CASE WHEN fa.auto_applied THEN 'Automated isolation applied (' || fa.rules_count || ' rules active).'
       WHEN fa.action_type = 'SOC_ALERT' THEN 'Review and approve prepared containment policies in the dashboard.'
       ELSE 'Initiate manual incident response process.' END,
    'Investigate path: ' || array_to_string(b.nodes, ' → ') || ' (risk=' || format('{{:.2f}}', b.risk_score) || ').',
    'Conduct forensic analysis of all compromised nodes.',
    'Reset credentials for all users associated with compromised workloads.') AS recommended_actions
FROM (SELECT (SELECT count(*) FROM flagged) AS total_flagged_edges, (SELECT count(*) FROM alert_nodes) AS node_count,
        (SELECT count(*) FROM paths) AS total_attack_paths, (SELECT coalesce(max(risk_score), 0) FROM paths)::DOUBLE AS risk)
LEFT JOIN best b ON b.rn = 1 LEFT JOIN first_action fa ON true"""

# -- drift


def _psi(source: str) -> str:
    """``source``: feature, expected, v."""
    return f"""
WITH cuts AS (
  SELECT feature, list_concat([q[1] - 1e-9], q[2:10], [q[11] + 1e-9]) AS q FROM (
    SELECT feature, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q
    FROM {source} WHERE expected GROUP BY 1)),
tagged AS (
  SELECT s.feature, s.expected, CASE WHEN s.v BETWEEN c.q[1] AND c.q[11]
    THEN least(len(list_filter(c.q, lambda e: e <= s.v)) - 1, 9) END AS bucket
  FROM {source} s JOIN cuts c USING (feature)),
shares AS (
  SELECT feature, i,
    greatest(count(*) FILTER (expected AND bucket = i) / count(*) FILTER (expected), 1e-6) AS e,
    greatest(count(*) FILTER (NOT expected AND bucket = i) / count(*) FILTER (NOT expected), 1e-6) AS a
  FROM tagged, (SELECT unnest(range(10)) AS i) GROUP BY 1, 2)
SELECT feature, sum((a - e) * ln(a / e)) AS psi FROM shares GROUP BY 1"""


CTES["psi_values"] = f"SELECT event_type AS feature, ts < {_NOW} - INTERVAL 7 DAYS AS expected, value AS v FROM events"
CTES["psi_value"] = _psi("psi_values")
CTES["drift_values"] = " UNION ALL ".join(
    f"SELECT '{g}:{i}' AS feature, ts < {_NOW} - INTERVAL 7 DAYS AS expected, ({x})::DOUBLE AS v FROM tel WHERE ts >= {_NOW} - INTERVAL 30 DAYS"
    for g, cells in (
        ("behavioral", ("bytes_transferred", "port")), ("temporal", ("hour(ts)", "isodow(ts) - 1")),
        ("structural", ("length(source_node)", "length(destination_node)")),
    ) for i, x in enumerate(cells)
)
CTES["drift_psi"] = _psi("drift_values")
CTES["checks"] = f"""
SELECT *, CASE WHEN psi_score > 0.25 THEN 'drift' WHEN psi_score > 0.1 THEN 'moderate' ELSE 'stable' END AS status,
  psi_score > 0.25 AS triggered_retrain, {_NOW} AS detected_at
FROM (SELECT split_part(feature, ':', 1) AS feature_group, avg(psi) AS psi_score, count(*) AS features FROM drift_psi GROUP BY 1)"""


CTES["shifted_values"] = " UNION ALL ".join(
    f"SELECT '{g}:{i}' AS feature, ts < {_NOW} - INTERVAL 7 DAYS AS expected, ({x})::DOUBLE AS v FROM tel WHERE ts >= {_NOW} - INTERVAL 30 DAYS"
    for g, cells in (
        ("behavioral", (f"bytes_transferred * CASE WHEN ts >= {_NOW} - INTERVAL 7 DAYS THEN 4 ELSE 1 END", "port")),
        ("temporal", ("hour(ts)", "isodow(ts) - 1")),
        ("structural", tuple(
            f"length({end}) + CASE WHEN ts >= {_NOW} - INTERVAL 7 DAYS AND hour(ts) < 6 THEN 2 ELSE 0 END"
            for end in ("source_node", "destination_node")
        )),
    ) for i, x in enumerate(cells)
)
CTES["shifted_psi"] = _psi("shifted_values")
CTES["shifted_checks"] = CTES["checks"].replace("drift_psi", "shifted_psi")
CTES["shadow_begin"] = "SELECT max(detected_at) AS t FROM shifted_checks WHERE triggered_retrain"

# -- bulk graph
CTES["bulk_lines"] = """
SELECT 'c-' || o.o_custkey AS c, 's-' || l.l_suppkey AS s, 'p-' || l.l_partkey AS p
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey"""
CTES["bulk_edges"] = """
SELECT c AS src, s AS dst FROM bulk_lines UNION SELECT s, p FROM bulk_lines UNION SELECT c, p FROM bulk_lines"""
CTES["bulk_nodes"] = "SELECT src AS node_id FROM bulk_edges UNION SELECT dst FROM bulk_edges"
_graph = ["und", "deg", "tri", "clust", "outdeg", "pr_n", *[f"pr_{i}" for i in range(51)], "pr_all", "pr_stop", "pr"]
for _name in _graph:
    CTES[f"bulk_{_name}"] = re.sub(
        r"\b(" + "|".join(["edges", "nodes", *_graph]) + r")\b", r"bulk_\1", CTES[_name]
    )


# -- two full passes a week apart
def _needed(name: str, seen: dict[str, None]) -> dict[str, None]:
    for other in re.findall(r"\b[a-z_]+[0-9]*\b", CTES[name]):
        if other in CTES and other not in seen and other != name:
            seen[other] = None
            _needed(other, seen)
    return seen


_first = [n for n in ["scores", *_needed("scores", {})] if n != "ev"]
for _name in _first:
    CTES[f"old_{_name}"] = re.sub(r"\b(" + "|".join(_first) + r")\b", r"old_\1", CTES[_name])
CTES["old_latest"] = "SELECT t - INTERVAL 7 DAYS AS t FROM latest"
CTES["old_tel"] = "SELECT * FROM tel WHERE ts <= (SELECT t FROM old_latest)"
CTES["old_degree"] = "SELECT src, max(out_degree)::DOUBLE AS baseline FROM old_rules GROUP BY src HAVING bool_or(reached)"
CTES["then_rules"] = _rules("edges", _NOW, "old_degree")
CTES["then_drift"] = """
SELECT node_id, CASE WHEN sum(e * e) = 0 OR sum(b * b) = 0 THEN 0
  ELSE (1 - sum(e * b) / (sqrt(sum(e * e)) * sqrt(sum(b * b)))) / 2 END AS drift
FROM (SELECT n.node_id, n.x AS e, 0.95 * o.x + 0.05 * n.x AS b FROM so_3 n JOIN old_so_3 o ON o.node_id = n.node_id AND o.i = n.i) GROUP BY 1"""
CTES["then_scores"] = f"""
SELECT *, greatest(gnn_score, rule_score) AS total_score, greatest(gnn_score, rule_score) > 0.7 AS is_flagged FROM (
  SELECT *, 0.5::DOUBLE * d_b + 0.3::DOUBLE * d_t + 0.2::DOUBLE * d_g AS gnn_score FROM (
    SELECT e.src, e.dst, greatest(coalesce(f.drift, 0), {_fresh(_NOW, 'd.since_3 IS NOT NULL')}) AS d_b, g.deviation AS d_t, c.d_g,
      r.rule_score, r.rule_triggered
    FROM edges e JOIN nodes d ON d.node_id = e.dst JOIN gap g ON g.src = e.src AND g.dst = e.dst
    JOIN cosd c ON c.src = e.src AND c.dst = e.dst JOIN then_rules r ON r.src = e.src AND r.dst = e.dst
    LEFT JOIN then_drift f ON f.node_id = e.src))"""


# -- the detection stream: a pass after each slice, against the baselines of the passes before it
_chain = [n for n in ["paths", *_needed("paths", {})] if n != "ev"]
STEPS = ("sa_", "sb_", "sc_", "sd_")
for _i, _s in enumerate(STEPS):
    for _name in _chain:
        CTES[_s + _name] = re.sub(r"\b(" + "|".join(_chain) + r")\b", _s + r"\1", CTES[_name])
    CTES[f"{_s}latest"] = f"SELECT max(t) AS t FROM marks WHERE slice <= {_i}"
    CTES[f"{_s}tel"] = f"SELECT * FROM tel WHERE ts <= (SELECT t FROM {_s}latest)"
    CTES[f"{_s}rules"] = f"SELECT * FROM step_rules_{_i}"
    _last = STEPS[_i - 1] if _i else None
    CTES[f"{_s}base"] = f"SELECT n.node_id, n.i, coalesce(0.95 * o.b + 0.05 * n.x, n.x) AS b FROM {_s}so_3 n LEFT JOIN {_last}base o ON o.node_id = n.node_id AND o.i = n.i" \
        if _i else f"SELECT node_id, i, x AS b FROM {_s}so_3"
    CTES[f"{_s}drift"] = f"""
SELECT node_id, CASE WHEN sum(e * e) = 0 OR sum(b * b) = 0 THEN 0
  ELSE (1 - sum(e * b) / (sqrt(sum(e * e)) * sqrt(sum(b * b)))) / 2 END AS drift
FROM (SELECT n.node_id, n.x AS e, m.b FROM {_s}so_3 n JOIN {_s}base m ON m.node_id = n.node_id AND m.i = n.i
  JOIN {_last}base o ON o.node_id = n.node_id AND o.i = n.i) GROUP BY 1""" if _i else "SELECT NULL::VARCHAR AS node_id, 0.0::DOUBLE AS drift"
    CTES[f"{_s}scores"] = re.sub(
        r"\b(edges|nodes|gap|cosd|latest)\b", _s + r"\1", CTES["then_scores"].replace("then_rules", f"{_s}rules").replace("then_drift", f"{_s}drift")
    )


def _drift_replay(source: str) -> str:
    return f"""
WITH RECURSIVE seq AS (
  SELECT CAST(label AS VARCHAR) AS node_id, vec_id AS pass, CAST(embedding AS DOUBLE[]) AS e,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM {source}),
walk AS (
  SELECT node_id, pass, rn, e, e AS b FROM seq WHERE rn = 1
  UNION ALL
  SELECT s.node_id, s.pass, s.rn, s.e, [w.b[i] * 0.95 + s.e[i] * 0.05 for i in range(1, len(s.e) + 1)]
  FROM walk w JOIN seq s ON s.node_id = w.node_id AND s.rn = w.rn + 1)
SELECT node_id, pass, rn = 1 AS first_pass,
  round(CASE WHEN rn = 1 THEN 0 ELSE (1 - list_inner_product(e, b) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(b, b)))) / 2 END, 6) AS drift
FROM walk"""


def sql(body: str) -> str:
    """``body`` with every common table expression it needs, in order of use."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[a-z_]+[0-9]*\b", text):
            if name in CTES and name not in order and name not in visiting:
                visiting.add(name)
                need(CTES[name])
                order.append(name)

    visiting: set[str] = set()
    need(body)
    if not order:
        return body
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order)
    return f"WITH {heads}\n{body}"


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_six = [f"{w}_{m}" for w in ("current", "short", "long") for m in ("rate", "mean")]
_series = []
for _name, _span, _min in (("current", "5 MINUTES", 5), ("short", "24 HOURS", 1440), ("long", "7 DAYS", 10080)):
    _w = f"OVER (PARTITION BY src ORDER BY ts RANGE BETWEEN INTERVAL {_span} PRECEDING AND CURRENT ROW)"
    _series += [
        f"count(*) {_w} AS {_name}_count", f"round(avg(bytes_transferred) {_w}, 6) AS {_name}_mean",
        f"round(coalesce(stddev_samp(bytes_transferred) {_w}, 0), 6) AS {_name}_std",
        f"round(count(*) {_w} / {_min}.0, 6) AS {_name}_rate",
    ]
_clocked = ", ".join(
    f"round({x}, 6) AS {n}" for x, n in zip(_clock("ts"), ("hour_sin", "hour_cos", "day_sin", "day_cos"))
)

BODIES: dict[str, str] = {
    "multi_source_union": "SELECT event_type, count(*) AS n, CAST(sum(bytes_transferred) AS BIGINT) AS bytes, count(*) FILTER (success) AS ok, min(ts) AS first_ts FROM good GROUP BY 1",
    "normalize_events": "SELECT * FROM good",
    "normalize_rejects": "SELECT event_id, source_node, destination_node, event_type, reject_reason FROM typed WHERE reject_reason IS NOT NULL",
    "resolve_nodes": "SELECT source_node, destination_node, count(*) AS n FROM typed GROUP BY 1, 2",
    "parse_timestamps": "SELECT event_id, ts FROM typed",
    "node_type_infer": f"""SELECT destination_node, port, count(*) AS n,
      CASE WHEN destination_node LIKE 'db-%' OR port IN ({_DB}) THEN 'asset' WHEN destination_node LIKE 'usr-%' THEN 'user' ELSE 'workload' END AS node_type,
      CASE WHEN destination_node LIKE 'db-%' OR port IN ({_DB}) THEN 4 WHEN port IN ({_HIGH}) THEN 3 ELSE 1 END AS sensitivity FROM tel GROUP BY 1, 2""",
    "endpoint_expand": "SELECT event_id, role, node_id, node_type, sensitivity, ip_address, is_critical FROM ends",
    "suspicious_process": "SELECT event_id, process FROM tel WHERE process IN ('psexec','wmic','powershell','cmd','bash','sh')",
    "business_hours": "SELECT hour(ts) BETWEEN 8 AND 18 AND isodow(ts) <= 5 AS business_hours, event_type, count(*) AS n FROM tel GROUP BY 1, 2",
    "edge_fold": f"SELECT {_EDGE}, lateral_tool, admin_port FROM edges",
    "edge_metadata": "SELECT src, dst, process, port, count(*) AS n FROM flows WHERE src <> dst GROUP BY 1, 2, 3, 4",
    "node_merge": "SELECT node_id, node_type, sensitivity, is_critical, ip_address, event_count, since_3, since_4 FROM nodes",
    "node_merge_prefix_only": "SELECT node_id, node_type, sensitivity, is_critical FROM nodes_prefix",
    "node_event_counts": "SELECT node_id, event_count FROM nodes WHERE event_count > 0",
    "edge_weights": f"SELECT src, dst, {_r('frequency_score', 'sensitivity_score', 'deviation_score', 'weight')} FROM weighted",
    "edge_weights_pit": "SELECT w.src, w.dst, round(p.frequency_score, 6) AS frequency_score, round(0.4::DOUBLE * p.frequency_score + 0.3::DOUBLE * w.sensitivity_score + 0.3::DOUBLE * w.deviation_score, 6) AS weight FROM weighted w JOIN pit p ON p.src = w.src AND p.dst = w.dst",
    "edge_deviation": f"SELECT src, dst, {_r('deviation_score')} FROM weighted",
    "edge_decay": f"SELECT src, dst, round({_DECAY}, 6) AS weight FROM weighted",
    "edge_prune": f"SELECT count(*) FILTER (last_seen >= {_NOW} - INTERVAL 7 DAYS) AS kept, CAST(sum(event_count) FILTER (last_seen >= {_NOW} - INTERVAL 7 DAYS) AS BIGINT) AS kept_events, count(*) FILTER (last_seen < {_NOW} - INTERVAL 7 DAYS) AS removed FROM edges",
    "graph_stats": "SELECT count(*) AS node_count, count(*) FILTER (sensitivity >= 3 OR is_critical) AS sensitive_nodes, (SELECT count(*) FROM edges) AS edge_count FROM nodes",
    "graph_snapshot": f"SELECT {_EDGE}, epoch_us({_NOW}) AS as_of_us FROM edges",
    "sensitive_nodes": "SELECT node_id, sensitivity, is_critical FROM nodes WHERE sensitivity >= 3 OR is_critical",
    "graph_lookup": "SELECT node_id, node_type, sensitivity, is_critical, ip_address, '' AS hostname FROM nodes WHERE node_id = 'db-0'",
    "edge_lookup": f"SELECT {_EDGE} FROM edges WHERE src = 'wl-4' AND dst = 'db-0'",
    "neighbors": "SELECT src AS node_id, 'out' AS direction, dst AS neighbor FROM edges UNION ALL SELECT dst, 'in', src FROM edges",
    "window_stats": f"SELECT src, event_id, {', '.join(_series)} FROM flows",
    "window_stats_without_ids": f"SELECT src, ts, bytes_transferred, {', '.join(_series)} FROM flows",
    "edge_temporal_features": f"SELECT src, dst, {_r(*_six)} FROM pw",
    "node_temporal_features": "SELECT node_id, short_count AS activity_count, round(short_rate, 6) AS activity_rate, round(short_mean, 6) AS activity_mean, round(short_std, 6) AS activity_std FROM nw",
    "temporal_deviation": f"SELECT src, dst, {_r('deviation')} FROM gap",
    "rolling_retention": "SELECT e.src, e.dst, p.long_count AS kept, e.event_count - p.long_count AS evicted FROM edges e JOIN pw p ON p.src = e.src AND p.dst = e.dst",
    "time_encoding": f"SELECT event_id, {_clocked} FROM tel",
    "node_behavioral": f"SELECT node_id, {_r(*_B)} FROM behave",
    "node_type_encoding": "SELECT node_id, " + ", ".join(f"({c})::DOUBLE AS t{i}" for i, c in enumerate([*_TYPE, "0", "0", "0"])) + " FROM nodes n",
    "pagerank": "SELECT node_id, round(pagerank, 8) AS pagerank, converged FROM pr",
    "clustering_coefficient": "SELECT node_id, triangles, round(clustering, 6) AS clustering FROM clust",
    "node_structural": f"SELECT node_id, {_r('pagerank', 'clustering', 'out_share', 'in_share')} FROM struct",
    "node_features": "SELECT node_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM feat",
    "sage_layer_sql": "SELECT node_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM so_3",
    "sage_weights_roundtrip": "SELECT node_id, true AS same FROM nodes",
    "sage_embeddings_in": "SELECT node_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM si_3",
    "cosine_distance": """SELECT e.vec_id, round((1 - list_inner_product(e.v, a.v) / (sqrt(list_inner_product(e.v, e.v)) * sqrt(list_inner_product(a.v, a.v)))) / 2, 6) AS distance
      FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) e
      JOIN (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS v FROM embeddings GROUP BY 1) a USING (label)""",
    "embedding_drift": _drift_replay("embeddings"),
    "embedding_drift_reset": _drift_replay("embeddings WHERE vec_id >= (SELECT max(vec_id) // 2 FROM embeddings)"),
    "edge_novelty": f"SELECT e.src, e.dst, round({_fresh(_NOW, 'd.since_3 IS NOT NULL')}, 6) AS novelty FROM edges e JOIN nodes d ON d.node_id = e.dst",
    "rule_scores": f"SELECT src, dst, {_r('rule_score')}, rule_triggered FROM rules",
    "degree_spikes": " UNION ALL ".join(f"SELECT pass, src, degree, edges_reached, spike, round(baseline, 6) AS baseline FROM pass_deg_{i}" for i in range(PASSES)),
    "edge_scores": f"SELECT src, dst, {_r('d_b', 'd_t', 'd_g', 'gnn_score', 'rule_score', 'total_score')}, rule_triggered, is_flagged FROM scores",
    "flagged_edges": f"SELECT src, dst, {_r('total_score')}, rule_triggered FROM flagged",
    "compromised_nodes": "SELECT DISTINCT src AS node_id FROM top5 WHERE total_score > 0.85 OR (rn = 1 AND (SELECT max(total_score) FROM top5) <= 0.85)",
    "attack_paths": f"SELECT {_PATH} FROM paths",
    "attack_paths_decayed": f"SELECT {_PATH} FROM dp_rated",
    "path_undetected_prob": "SELECT path_id, round(pow(1 - 0.89::DOUBLE, hop_count), 9) AS undetected_probability FROM paths",
    "top_paths": "SELECT path_id, round(risk_score, 6) AS risk_score FROM paths ORDER BY paths.risk_score DESC, nodes LIMIT 10",
    "risk_classes": "SELECT risk_class, count(*) AS n, round(max(risk_score), 6) AS max_risk FROM paths GROUP BY 1",
    "severity_labels": f"SELECT {_SEV.format('weight')} AS severity, count(*) AS n FROM weighted GROUP BY 1",
    "impact_scores": "SELECT node_id, round(((CASE sensitivity WHEN 4 THEN 1.0 WHEN 3 THEN 0.7 WHEN 2 THEN 0.4 ELSE 0.1 END) + CASE WHEN is_critical THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS impact FROM nodes",
    "aggregate_risk": "SELECT round(coalesce(max(risk_score), 0), 6) AS risk FROM paths",
    "business_impact": "SELECT round(coalesce(sum(l.weight), 0), 6) AS blocked_weight, round(coalesce(sum(l.weight), 0) / greatest((SELECT sum(weight) FROM live), 1e-9), 6) AS impact FROM (SELECT DISTINCT src, dst FROM cut) c JOIN live l ON l.src = c.src AND l.dst = c.dst",
    "containment_actions": f"SELECT action_id, risk_class, action_type, {_r('risk_score', 'business_impact')}, path_count, edge_count, auto_applied, created_at, applied_at FROM actions",
    "action_targets": "SELECT DISTINCT a.action_id, x.node_id FROM (SELECT risk_class, target AS node_id FROM paths UNION ALL SELECT c.risk_class, s.node_id FROM starts s, (SELECT unnest(['AUTO_ISOLATE', 'SOC_ALERT']) AS risk_class) c) x JOIN actions a USING (risk_class)",
    "containment_rules": f"SELECT {_RULE} FROM fw",
    "active_rules": f"SELECT {_RULE} FROM fw WHERE auto_applied AND expires_at > {_NOW} + INTERVAL 23 HOURS",
    "rollback_rules": "SELECT rule_id, action_id FROM fw WHERE action_id NOT IN (SELECT action_id FROM actions WHERE risk_class = 'SOC_ALERT')",
    "rollback_status": "SELECT action_id, risk_class = 'SOC_ALERT' AS rollback_applied FROM actions",
    "containment_history": f"SELECT action_id, action_type, {_r('risk_score', 'business_impact')}, auto_applied, (SELECT count(*) FROM fw f WHERE f.action_id = a.action_id) AS rules_count, created_at, applied_at FROM actions a",
    "mitre_tactics": "SELECT tactics FROM tactics",
    "alert_build": f"""SELECT alert_id, severity, title, description, node_count, recommended_actions, (SELECT tactics FROM tactics) AS mitre_tactics,
      (SELECT string_agg(array_to_string(nodes, '>'), '|' ORDER BY rn) FROM best) AS attack_paths,
      (SELECT string_agg(src || '>' || dst, '|' ORDER BY total_score DESC, src, dst) FROM (SELECT * FROM flagged ORDER BY total_score DESC, src, dst LIMIT 20)) AS anomaly_scores,
      action_type, rules_count, {_NOW} AS created_at, total_flagged_edges, total_attack_paths, round(max_risk_score, 6) AS max_risk_score FROM alert""",
    "alert_json": f"""SELECT 'security-alerts' AS topic, alert_id AS key, severity, title, CAST(p.page AS INTEGER) AS page, CAST(pages AS INTEGER) AS pages,
      coalesce((SELECT string_agg(node_id, ',' ORDER BY node_id) FROM alert_nodes WHERE CAST('0x' || substr(md5(node_id), 1, 8) AS BIGINT) % pages = p.page), '') AS compromised_nodes,
      CAST((SELECT count(*) FROM best) AS INTEGER) AS path_count, action_type, rules_count, strftime({_NOW}, '%Y-%m-%dT%H:%M:%S.%f') AS created_at
      FROM (SELECT *, greatest(1, CAST(ceil(node_count / 1000) AS BIGINT)) AS pages, unnest(range(greatest(1, CAST(ceil(node_count / 1000) AS BIGINT)))) AS page FROM alert) p""",
    "alert_list": "SELECT alert_id, severity, created_at, total_flagged_edges, round(max_risk_score, 6) AS max_risk_score FROM alerts WHERE severity = 'LOW'",
    "alert_acknowledged": "SELECT alert_id, max_risk_score = 0 AS acknowledged FROM alerts",
    "psi_feature": "SELECT feature, round(psi, 6) AS psi FROM psi_value",
    "drift_check": "SELECT feature_group, round(psi_score, 6) AS psi_score, features, status, triggered_retrain, detected_at FROM checks",
    "drift_status": "SELECT feature_group, round(psi_score, 6) AS psi, CASE WHEN triggered_retrain THEN sha256(feature_group || '|' || epoch_us(detected_at)) END AS drift_id FROM checks",
    "drift_check_shifted": "SELECT feature_group, round(psi_score, 6) AS psi_score, features, status, triggered_retrain, detected_at FROM shifted_checks",
    "drift_events_shifted": "SELECT sha256(feature_group || '|' || epoch_us(detected_at)) AS drift_id, feature_group, detected_at, round(psi_score, 6) AS psi_score FROM shifted_checks WHERE triggered_retrain",
    "drift_gate": "SELECT 8 AS days, feature_group, status, round(psi_score, 6) AS psi_score FROM shifted_checks",
    "shadow_states": """SELECT state, on_now AS in_shadow_mode, CASE WHEN on_now THEN t END AS shadow_start, on_now AND state = 'old' AS can_promote FROM (
      SELECT state, t, t IS NOT NULL AND state <> 'promoted' AS on_now FROM shadow_begin, (SELECT unnest(['young', 'old', 'promoted']) AS state))""",
    "shadow_status": "SELECT count(*) > 0 AS in_shadow_mode, max(detected_at) AS shadow_start, count(*) > 0 AS can_promote FROM checks WHERE triggered_retrain",
}

BODIES |= {
    "stream_source_parse": """SELECT 'good' AS status, event_type AS what, count(*) AS n, CAST(sum(bytes_transferred) AS BIGINT) AS bytes,
        CAST(sum(epoch_us(ts)) AS DECIMAL(38, 0)) AS times
      FROM good WHERE CAST(event_id AS BIGINT) % 50 NOT IN (7, 9, 11) GROUP BY event_type
      UNION ALL SELECT 'bad', CASE WHEN CAST(event_id AS BIGINT) % 50 IN (7, 9, 11) THEN 'json' ELSE reject_reason END, count(*), NULL, NULL
      FROM typed WHERE CAST(event_id AS BIGINT) % 50 IN (7, 9, 11) OR reject_reason IS NOT NULL GROUP BY 2""",
    "stream_edge_state": BODIES["edge_fold"],
    "stream_edge_compaction": f"SELECT {_EDGE} FROM edges WHERE last_seen >= {_NOW} - INTERVAL 7 DAYS",
    "stream_window_stats": BODIES["edge_temporal_features"],
    "stream_sliding_counts": f"""SELECT s AS start, s + INTERVAL 24 HOURS AS "end", src, dst, n, bytes FROM (
      SELECT make_timestamp((epoch_us(ts) // 21600000000 - j) * 21600000000) AS s, src, dst, count(*) AS n,
        CAST(sum(bytes_transferred) AS BIGINT) AS bytes
      FROM flows, (SELECT unnest(range(4)) AS j) GROUP BY 1, 2, 3) WHERE s + INTERVAL 24 HOURS <= {_NOW} - INTERVAL 1 HOUR""",
    "stream_sliding_balance": f"""SELECT s AS start, s + INTERVAL 24 HOURS AS "end", src, dst, count(*) AS arrived,
        count(*) FILTER (kept AND closed) AS emitted, count(*) FILTER (kept AND NOT closed) AS open, count(*) FILTER (NOT kept) AS dropped FROM (
      SELECT *, coalesce(s + INTERVAL 24 HOURS > prior - INTERVAL 1 HOUR, true) AS kept, s + INTERVAL 24 HOURS <= {_NOW} - INTERVAL 1 HOUR AS closed FROM (
        SELECT f.src, f.dst, p.prior, make_timestamp((epoch_us(f.ts) // 21600000000 - j) * 21600000000) AS s
        FROM (SELECT *, least(3, (day(ts) - 1) // 8 + CASE WHEN port = 22 THEN 1 ELSE 0 END) AS a FROM flows) f
        JOIN (SELECT b, (SELECT max(ts) FROM tel WHERE least(3, (day(ts) - 1) // 8 + CASE WHEN port = 22 THEN 1 ELSE 0 END) < b) AS prior
          FROM (SELECT unnest(range(4)) AS b)) p ON p.b = f.a, (SELECT unnest(range(4)) AS j))) GROUP BY 1, 2, 3, 4""",
    "stream_late_events": """SELECT event_id, CAST(a AS INTEGER) AS batch_id, coalesce(ts < prior - INTERVAL 1 HOUR, false) AS late FROM (
      SELECT *, (SELECT max(ts) FROM tel o WHERE least(3, (day(o.ts) - 1) // 8 + CASE WHEN o.port = 22 THEN 1 ELSE 0 END) < a) AS prior FROM (
        SELECT *, least(3, (day(ts) - 1) // 8 + CASE WHEN port = 22 THEN 1 ELSE 0 END) AS a FROM tel))""",
    "stream_detection": " UNION ALL ".join(
        f"SELECT {i} AS batch_id, src, dst, {_r('d_b', 'd_t', 'rule_score', 'total_score')}, rule_triggered, is_flagged, (SELECT t FROM {s}latest) AS as_of FROM {s}scores"
        for i, s in enumerate(STEPS)
    ),
    "stream_alerts": " UNION ALL ".join(
        f"SELECT sha256('alert|' || epoch_us(t)) AS alert_id, {_SEV.format('risk')} AS severity, t AS created_at, ends AS node_count, n AS total_flagged_edges, "
        f"paths AS total_attack_paths, round(risk, 6) AS max_risk_score FROM (SELECT count(*) AS n FROM {s}flagged HAVING count(*) > 0), {s}latest, "
        f"(SELECT count(DISTINCT x) AS ends FROM (SELECT unnest([src, dst]) AS x FROM {s}flagged)), "
        f"(SELECT count(*) AS paths, coalesce(max(risk_score), 0)::DOUBLE AS risk FROM {s}paths)"
        for s in STEPS
    ),
    # Renaming the tables of a slice has renamed the column of that name, too.
    "stream_attack_paths": " UNION ALL ".join(
        f"SELECT {i} AS batch_id, {_PATH.replace('(nodes', f'({s}nodes')} FROM {s}paths" for i, s in enumerate(STEPS)
    ),
}


_scored = f"src, dst, {_r('d_b', 'd_t', 'rule_score', 'total_score')}, round(d_g, 5) AS d_g, rule_triggered, is_flagged"
BODIES["detection_passes"] = f"""SELECT CAST(0 AS INTEGER) AS pass_no, {_scored} FROM old_scores
      UNION ALL SELECT 1, {_scored} FROM then_scores"""
for _name in ("edge_weights", "rule_scores", "pagerank", "attack_paths", "window_stats"):
    BODIES[f"{_name}_split"] = BODIES[_name]
for _name in ("edge_temporal_features", "node_temporal_features", "temporal_deviation", "edge_weights", "edge_deviation"):
    BODIES[f"{_name}_cells"] = BODIES[_name]
BODIES["clustering_split"] = BODIES["clustering_coefficient"]
BODIES["pagerank_bulk"] = "SELECT node_id, round(pagerank, 8) AS pagerank, converged FROM bulk_pr"
BODIES["clustering_bulk"] = "SELECT node_id, triangles, round(clustering, 6) AS clustering FROM bulk_clust"


def oracle_sql() -> dict[str, str]:
    return {name: sql(body.replace("round(", "round(1e-12 + ")) for name, body in BODIES.items()}
