"""Fixed values and tunables. Everything a result depends on is stated here once."""

from dataclasses import dataclass

MICROS = 1_000_000
MINUTE_US = 60 * MICROS
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

# Canonical field -> accepted raw keys, most preferred first.
FIELD_KEYS = {
    "source_ip": ("source_ip", "src_ip"),
    "destination_ip": ("destination_ip", "dst_ip"),
    "port": ("port", "dst_port"),
    "bytes_transferred": ("bytes_transferred", "bytes"),
    "user": ("user", "username"),
    "process": ("process", "process_name"),
    "success": ("success", "result"),
}
# Raw keys that can name an endpoint, first non-empty one wins.
ENDPOINT_KEYS = {
    "source": ("source_node", "src_node", "source_id", "src_host", "src_ip"),
    "destination": ("destination_node", "dst_node", "dest_id", "dst_host", "dst_ip"),
}
# Telemetry source tags.
SOURCE_TAGS = (
    "network_flow", "process_exec", "cloud_audit", "container", "authentication",
    "application", "dns", "vpn", "file_access",
)
# Port and process lists.
DB_PORTS = (3306, 5432, 1433, 1521, 27017, 6379)
SENSITIVE_PORTS = (22, 3389, 445)
ADMIN_PORTS = (22, 3389, 445, 135, 5985, 5986)
SUSPICIOUS_PROCESSES = ("psexec", "wmic", "powershell", "cmd", "bash", "sh")
LATERAL_TOOLS = ("psexec", "wmic", "winrm", "dcom", "mimikatz", "cobalt")
# Keyword -> tactic and technique labels, in listing order.
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
# Sensitivity levels and the impact of losing a node of that level.
LOW, MEDIUM, HIGH, CRITICAL = 1, 2, 3, 4
IMPACT = {LOW: 0.1, MEDIUM: 0.4, HIGH: 0.7, CRITICAL: 1.0}
CRITICAL_BONUS = 0.2
UNKNOWN_IMPACT = 0.1

# Rule names.
RULE_SENSITIVE = "R1:new_edge_to_sensitive"
RULE_NEW = "R1:new_edge"
RULE_TOOL = "R2:lateral_movement_tool"
RULE_PORT = "R3:admin_port_"
RULE_SPIKE = "R4:degree_spike"
# Reasons of firewall rules; {risk} has two decimals.
REASON_NODE = "Compromised node isolation (risk={risk})"
REASON_EDGE = "Attack path edge block (risk={risk})"
# Alert texts.
ALERT_TITLE = "[{severity}] Potential Lateral Movement Detected — {nodes} node(s)"
ALERT_FLAGGED = "GNN anomaly detector flagged {edges} suspicious edges."
ALERT_WORST = " Highest risk path: {source} → {target} (risk={risk}, hops={hops})"
ADVICE_ISOLATED = "Automated isolation applied ({rules} rules active)."
ADVICE_REVIEW = "Review and approve prepared containment policies in the dashboard."
ADVICE_MANUAL = "Initiate manual incident response process."
ADVICE_PATH = "Investigate path: {path} (risk={risk})."
ADVICE_CLOSING = (
    "Conduct forensic analysis of all compromised nodes.",
    "Reset credentials for all users associated with compromised workloads.",
)


@dataclass(frozen=True)
class Settings:
    """Fixed values of the method (weights, thresholds, windows, model), and tunables at the end."""

    # edge weight blend
    w_frequency: float = 0.4
    w_sensitivity: float = 0.3
    w_deviation: float = 0.3
    decay_per_hour: float = 0.1
    prune_days: int = 7
    # trailing windows
    current_us: int = 5 * MINUTE_US
    short_us: int = DAY_US
    long_us: int = 7 * DAY_US
    # edge score blend
    w_behavioral: float = 0.5
    w_temporal: float = 0.3
    w_structural: float = 0.2
    flag_above: float = 0.7
    novelty_hours: float = 1.0
    novelty_sensitive: float = 0.75
    novelty_other: float = 0.20
    rule_tool: float = 0.80
    rule_port: float = 0.65
    rule_port_max_events: int = 2
    rule_spike: float = 0.60
    spike_factor: float = 2.5
    degree_alpha: float = 0.1
    embedding_alpha: float = 0.05
    # attack paths and containment
    max_hops: int = 5
    min_probability: float = 0.001
    default_weight: float = 0.5
    p_detect: float = 0.89
    compromised_top: int = 5
    compromised_above: float = 0.85
    isolate_above: float = 0.8
    soc_above: float = 0.5
    impact_auto: float = 0.05
    impact_soc: float = 0.20
    rule_ttl_hours: int = 24
    # drift
    psi_buckets: int = 10
    psi_warn: float = 0.10
    psi_critical: float = 0.25
    drift_check_days: int = 7
    drift_window_days: int = 30
    drift_min_rows: int = 20
    shadow_days: int = 7
    # embedding model
    dims: tuple = (64, 128, 64, 32)
    model_seed: int = 42
    # power iteration
    damping: float = 0.85
    rank_tolerance: float = 1e-6
    rank_rounds: int = 50
    # skew: a key is hot when it holds more than `hot_min_rows` rows and more than
    # 1/hot_share of the table, so there are always fewer than hot_share hot keys.
    hot_share: int = 100_000
    hot_min_rows: int = 1_000_000
    slice_us: int = MINUTE_US
    # alert payload paging
    nodes_per_page: int = 1_000
    # message topics
    telemetry_topic: str = "telemetry-events"
    alert_topic: str = "security-alerts"


DEFAULT = Settings()

# The plan meant for large tables, at any size: keys of a few rows count as hot and timelines are cut every hour.
SPLIT = Settings(hot_min_rows=20, slice_us=3_600_000_000)
