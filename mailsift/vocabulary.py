"""Fixed values shared by every operator.

The words, tokens, thresholds and phrases below are data that results depend on;
they are listed in their natural order and used by name elsewhere.
"""

# Decision tiers, least to most severe.
TIERS = ("ALLOW", "WARN", "QUARANTINE", "BLOCK")
DELIVERED_TIERS = ("ALLOW", "WARN")

# How a decision was reached, and its nominal latency in milliseconds.
ROUTES = ("HARD_RULE", "MODEL", "LLM")
NOMINAL_ROUTE_MS = {"HARD_RULE": 1.0, "MODEL": 20.0, "LLM": 900.0}

# Ground-truth labels, and the corpus directory names that mean each.
LABELS = ("ham", "spam", "phish")
ABUSE_LABELS = ("spam", "phish")
CLASS_DIRECTORIES = {
    "ham": "ham",
    "easy_ham": "ham",
    "hard_ham": "ham",
    "spam": "spam",
    "phish": "phish",
    "phishing": "phish",
}

# Machine reason codes with the phrase each is explained by.
REASON_PHRASES = {
    "KNOWN_BAD_URL": "a link resolves to a known-malicious host",
    "MALFORMED_AUTH_BRAND_SPOOF": "the message impersonates a high-value brand but fails authentication (DMARC)",
    "BURST_OVERRIDE": "it is part of a detected sending burst, which escalated the verdict",
    "SUSPICIOUS_LINK": "a link shows phishing tells (a raw-IP or punycode host, or a look-alike domain)",
    "CREDENTIAL_PHISHING": "it solicits credentials or imitates an account-security flow",
    "URGENCY_PRESSURE": "it uses manufactured urgency or pressure tactics to force a quick action",
    "PRIZE_OR_LOTTERY_BAIT": "it dangles a prize, lottery, or other financial windfall as bait",
    "UNSOLICITED_BULK": "it is unsolicited bulk or promotional content with no prior relationship",
    "SENDER_REPUTATION_RISK": "the sender's reputation is poor or too uncertain to trust",
    "BENIGN_CONTENT": "no abusive signal was found in the message",
}
MODEL_RESPONSE_REASONS = (
    "SUSPICIOUS_LINK",
    "CREDENTIAL_PHISHING",
    "URGENCY_PRESSURE",
    "PRIZE_OR_LOTTERY_BAIT",
    "UNSOLICITED_BULK",
    "SENDER_REPUTATION_RISK",
    "BENIGN_CONTENT",
)
TIER_VERDICTS = {
    "ALLOW": "Allowed",
    "WARN": "Delivered with a warning",
    "QUARANTINE": "Quarantined",
    "BLOCK": "Blocked",
}
NO_RULE_SENTENCE = "No hard rule fired; the model scored it as benign and the active policy allowed it."
NO_REASON_SUFFIX = ", but no specific reason was recorded."

# Why a row is escalated to the slow path, in evaluation order.
ROUTING_REASONS = ("LOW_MODEL_CONFIDENCE", "NEW_SENDER_UNCERTAINTY", "NEAR_TIER_BOUNDARY")

# Slow-path verdicts and the tier each one maps to.
VERDICT_TIERS = {"LEGITIMATE": "ALLOW", "SPAM": "QUARANTINE", "PHISHING": "BLOCK"}
MAX_EXPLANATION_CHARS = 600

# Sender reputation.
SIGNALS = ("GOOD", "BAD")
BUCKETS = ("AUTHENTICATED", "UNAUTHENTICATED")
UNKNOWN_SENDER = "unknown-sender"
PRIOR_ALPHA = 1.0
PRIOR_BETA = 1.0
HALF_LIFE_SECONDS = 7 * 24 * 3600.0

# Burst detection.
BURST_WINDOW_MS = 60_000
BURST_TIER = "QUARANTINE"
NEAR_DUPLICATE_RADIUS = 6

# Feedback corroboration.
MALICIOUS_TRUST = 0.1
MIN_CORROBORATORS = 3
MIN_GROUP_WEIGHT = 1.5
MAX_REPUTATION_WEIGHT = 5.0
DRIFT_TOLERANCE = 0.5
FEEDBACK_SIGNALS = {"CLICK": "GOOD", "RESCUE": "GOOD", "REPORT": "BAD"}

# Evaluation split, calibration and promotion gates.
EVAL_FRACTION = 0.2
EVAL_SEED = 42
CALIBRATION_BINS = 10
MAX_ECE = 0.10
MIN_CALIBRATION_SAMPLES = 50
PRECISION_FLOOR = 0.95
MIN_GOLDEN_SAMPLES = 50

# Slow-path spend limits in US dollars and token prices per thousand.
DAILY_CAP_USD = 0.50
MONTHLY_CAP_USD = 5.00
RESERVATION_USD = 0.01
INPUT_USD_PER_1K = 0.00015
OUTPUT_USD_PER_1K = 0.00060
SLA_SECONDS = 30

# Campaigns and text encoding.
CAMPAIGN_SIMILARITY = 0.80
HASH_DIMENSION = 4096
ENCODER_DIMENSION = 128
FEATURE_VERSION = 1
FEATURE_COUNT = 24

# The hard-rule lists shipped as defaults.
DEFAULT_URL_DENYLIST = (
    "malware.example",
    "phishing.example",
    "baddomain.test",
    "secure-bank-verify.example",
    "prize-claim-center.example",
)
DEFAULT_BRANDS = (("paypal", "paypal.com"), ("microsoft", "microsoft.com"), ("apple", "apple.com"))
