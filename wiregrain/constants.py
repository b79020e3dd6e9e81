"""Values the results depend on.

Everything below is a set of FIXED VALUES: protocol code tables, ports, label
numbers, address pools and thresholds that any implementation has to agree on.
"""

from __future__ import annotations

# --- Fixed values: function-code names -------------------------------------
MODBUS_FUNCTIONS = {
    1: "Read Coils",
    2: "Read Discrete Inputs",
    3: "Read Holding Registers",
    4: "Read Input Registers",
    5: "Write Single Coil",
    6: "Write Single Register",
    15: "Write Multiple Coils",
    16: "Write Multiple Registers",
    23: "Read/Write Multiple Registers",
}
DNP3_FUNCTIONS = {
    0: "CONFIRM",
    1: "READ",
    2: "WRITE",
    3: "SELECT",
    4: "OPERATE",
    5: "DIRECT_OPERATE",
    6: "DIRECT_OPERATE_NO_ACK",
    7: "FREEZE",
    8: "FREEZE_NO_ACK",
    129: "RESPONSE",
    130: "UNSOLICITED_RESPONSE",
}

# --- Fixed values: ports, read and write codes, unit range ------------------
MODBUS_PORT = 502
DNP3_PORT = 20000
MODBUS_READS = [1, 2, 3, 4]
MODBUS_WRITES = [5, 6, 15, 16]
DNP3_READS = [1]
DNP3_WRITES = [2, 4, 5]
MODBUS_UNIT_RANGE = (1, 247)

# --- Fixed values: entropy classes (upper bound, text) and normal range -----
ENTROPY_CLASSES = [
    (2.0, "Very Low (Highly repetitive)"),
    (4.0, "Low (Structured data)"),
    (6.0, "Medium (Mixed content)"),
    (7.0, "High (Varied data)"),
]
ENTROPY_TOP_CLASS = "Very High (Random/Encrypted)"
ENTROPY_NORMAL = (3.5, 6.5)

# --- Fixed values: anomaly rule thresholds and reason texts -----------------
SIGMA = 2.0
ENTROPY_LOW = 2.0
ENTROPY_HIGH = 7.0
BURST_MS = 1.0
BURST_RUN = 10
STABILITY_MIN = 0.5
MAX_FUNCTION_CODES = 10
RESERVED_CODES = [(7, 14), (17, 19), (24, 127)]
REASON_STATISTICAL = "Statistical Outlier (Packet Size, IAT, or Entropy)"
REASON_PROTOCOL = (
    "Protocol Violation (Invalid Protocol ID, Unit ID, Length Mismatch, or Reserved FC)"
)
REASON_SCAN = "Pattern Anomaly: Function Code Scanning Detected in Flow"
REASON_RAPID = "Pattern Anomaly: Rapid Function Code Change"
REASON_BURST = "Pattern Anomaly: Burst Traffic (IAT < 1ms)"

# --- Fixed values: packet labels ---------------------------------------------
LABELS = {"N": 0, "P1": 1, "P2": 2, "P3": 3}

# --- Fixed values: attacker address pools (last octet, inclusive) and default safe register ranges
ADDRESS_POOLS = {
    "P1_APT": (10, 19),
    "P2_Insider": (20, 29),
    "P3_Opportunistic": (30, 39),
}
SAFE_RANGES = {40001: (10, 50), 40002: (20, 60), 40003: (5, 30), 40005: (0, 100)}
REGISTER_BASE = 40001

# --- Fixed values: normal-traffic criteria (metric, low, high); None = open --
BASELINE_CRITERIA = [
    ("iat_mean_ms", 10.0, 1000.0),
    ("iat_std_ms", 5.0, 500.0),
    ("iat_cv", None, 0.5),
    ("iat_skewness", -1.0, 1.0),
    ("iat_max_over_mean", None, 5.0),
    ("iat_jitter", None, 0.3),
    ("length_mean", 60.0, 300.0),
    ("length_std", 10.0, 50.0),
    ("length_min", 12.0, None),
    ("length_max", None, 260.0),
    ("length_cv", 0.1, 0.5),
    ("payload_entropy_mean", 3.5, 6.5),
    ("header_entropy_mean", 2.0, 4.0),
    ("full_packet_entropy_mean", 3.0, 6.0),
    ("function_codes", 2.0, 8.0),
    ("dominant_fc_share", 0.3, None),
    ("fc_change_share", None, 0.3),
    ("fc_stability", 0.5, None),
    ("fc_3_share", 0.4, 0.7),
    ("fc_16_share", 0.1, 0.3),
    ("error_share", None, 0.02),
    ("unique_src_ips", 1.0, 5.0),
    ("unique_dst_ips", 1.0, 50.0),
    ("unique_unit_ids", 1.0, 50.0),
]
# Criteria of messages, flows and the collection itself.
STANDARD_CODES = (1, 2, 3, 4, 5, 6, 15, 16, 23)
MESSAGE_CRITERIA = [
    ("protocol_id_share", 1.0, None),
    ("unit_id_share", 1.0, None),
    ("length_share", 1.0, None),
    ("standard_code_share", 1.0, None),
    ("request_response_ratio", 0.9, 1.1),
    ("packets_per_flow", 10.0, 10000.0),
    ("flow_duration_seconds", 1.0, 86400.0),
    ("flow_symmetry", 0.8, 1.2),
    ("collection_hours", 24.0, None),
    ("collection_packets", 10000.0, None),
]
# Criteria of conversations, of the mapping of addresses and of the two halves of a collection.
CONVERSATION_CRITERIA = [
    ("response_delay_mean_ms", 1.0, 100.0),
    ("response_delay_p95_ms", None, 150.0),
    ("orphan_packet_share", None, 0.01),
    ("regular_id_share", 0.9, None),
    ("autocorrelation", 0.7, None),
    ("mapping_stability", 0.95, None),
    ("length_drift_sigma", None, 2.0),
    ("coverage_share", 0.95, None),
]
MIN_PACKETS_PER_UNIT = 100
MIN_FUNCTION_CODE_ROWS = 10

# --- Fixed values: classifier settings --------------------------------------
FOREST = {"numTrees": 300, "maxDepth": 20, "minInstancesPerNode": 2, "seed": 42}
TEST_SHARE = 0.3
SEED = 42
