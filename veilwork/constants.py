"""Entity types, patterns, confidences, word lists, formats.

Everything here is data that decides results; nothing here computes.
"""

# Entity types, in list order.  The position is the tie-break
# between two detections of equal confidence and start.
REGEX_TYPES = (
    "EMAIL",
    "PHONE_NUMBER",
    "SSN",
    "CREDIT_CARD",
    "IBAN",
    "IP_ADDRESS",
    "IPV6_ADDRESS",
    "MAC_ADDRESS",
    "API_KEY_AWS",
    "API_KEY_OPENAI",
    "API_KEY_STRIPE",
    "API_KEY_GITHUB",
    "PASSPORT_NUMBER",
    "DATE_OF_BIRTH",
    "MEDICAL_ID",
    "DRIVERS_LICENSE",
    "URL_WITH_AUTH",
    "JWT_TOKEN",
)
NER_TYPES = ("PERSON_NAME", "ORGANIZATION", "ADDRESS", "MEDICAL_CONDITION", "LOCATION")
CUSTOM_TYPE = "CUSTOM"
ALL_TYPES = REGEX_TYPES + NER_TYPES + (CUSTOM_TYPE,)

# Patterns (Unicode meaning of \b, \d and \s; see functions.regex).
PATTERNS = {
    "EMAIL": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "PHONE_NUMBER": r"(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "SSN": r"\b(?!000|666|9\d{2})\d{3}-(?!00)\d{2}-(?!0000)\d{4}\b",
    "CREDIT_CARD": r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))"
    r"[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{1,4}\b",
    "IBAN": r"\b[A-Z]{2}\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{0,14}\b",
    "IP_ADDRESS": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}"
    r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "IPV6_ADDRESS": r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"
    r"|\b(?:[0-9a-fA-F]{1,4}:){1,7}:\b"
    r"|\b::(?:[0-9a-fA-F]{1,4}:){0,5}[0-9a-fA-F]{1,4}\b",
    "MAC_ADDRESS": r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b",
    "API_KEY_AWS": r"\bAKIA[0-9A-Z]{16}\b",
    "API_KEY_OPENAI": r"\bsk-[A-Za-z0-9]{20,}\b",
    "API_KEY_STRIPE": r"\b(?:sk_live|sk_test|pk_live|pk_test)_[A-Za-z0-9]{10,}\b",
    "API_KEY_GITHUB": r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}\b",
    "PASSPORT_NUMBER": r"\b[A-Z]\d{8}\b",
    "DATE_OF_BIRTH": r"\b(?:19|20)\d{2}[-/](?:0[1-9]|1[0-2])[-/](?:0[1-9]|[12]\d|3[01])\b",
    "MEDICAL_ID": r"\bMRN[-:]?\s?\d{4,10}\b",
    "DRIVERS_LICENSE": r"\b[A-Z]\d{3}[-\s]?\d{4}[-\s]?\d{4}\b",
    "URL_WITH_AUTH": r"https?://[^\s:@]+:[^\s:@]+@[^\s/]+",
    "JWT_TOKEN": r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\b",
}
IGNORE_CASE_TYPES = frozenset({"MEDICAL_ID"})

# Confidence of a match.
CONFIDENCE = {
    "EMAIL": 0.95,
    "PHONE_NUMBER": 0.85,
    "SSN": 0.92,
    "CREDIT_CARD": 0.90,
    "IBAN": 0.88,
    "IP_ADDRESS": 0.80,
    "IPV6_ADDRESS": 0.80,
    "MAC_ADDRESS": 0.90,
    "API_KEY_AWS": 0.95,
    "API_KEY_OPENAI": 0.92,
    "API_KEY_STRIPE": 0.95,
    "API_KEY_GITHUB": 0.95,
    "PASSPORT_NUMBER": 0.70,
    "DATE_OF_BIRTH": 0.65,
    "MEDICAL_ID": 0.90,
    "DRIVERS_LICENSE": 0.70,
    "URL_WITH_AUTH": 0.95,
    "JWT_TOKEN": 0.93,
}
# Factor applied when a check on the match fails.
CARD_CHECKSUM_FACTOR = 0.3
IBAN_LENGTH_FACTOR = 0.4

# IBAN length by country; other countries are not checked.
IBAN_LENGTHS = {
    "DE": 22, "GB": 22, "FR": 27, "ES": 24, "IT": 27, "NL": 18,
    "BE": 16, "AT": 20, "CH": 21, "PL": 28, "PT": 25, "SE": 24,
    "NO": 15, "FI": 18, "DK": 18, "IE": 22, "LU": 20, "CZ": 24,
}

# Recognizer labels and confidences.
NER_LABELS = {
    "PERSON": "PERSON_NAME",
    "ORG": "ORGANIZATION",
    "GPE": "LOCATION",
    "LOC": "LOCATION",
    "FAC": "ADDRESS",
}
NER_BASE = 0.75
NER_MULTI_WORD = 0.1
NER_CAPS_PERSON = 0.15
NER_SINGLE_CHAR = 0.2

# Context words.
CONTEXT_WINDOW = 80
CONTEXT_BOOST = 0.08
CONTEXT_REDUCTION = 0.15
CONTEXT_LABEL = 0.10
BOOSTERS = {
    "SSN": ["ssn", "social security", "social sec", "ss#", "ss #", "tax id"],
    "CREDIT_CARD": [
        "card", "credit", "debit", "visa", "mastercard", "amex", "payment",
        "cc", "card number", "card no",
    ],
    "EMAIL": ["email", "e-mail", "mail", "contact", "send to"],
    "PHONE_NUMBER": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact"],
    "DATE_OF_BIRTH": ["dob", "date of birth", "born", "birthday", "birth date", "birthdate"],
    "MEDICAL_ID": ["mrn", "medical record", "patient id", "patient number", "chart"],
    "PASSPORT_NUMBER": ["passport", "travel document", "passport no", "passport number"],
    "DRIVERS_LICENSE": ["driver", "license", "dl", "dl#", "driving licence", "dmv"],
    "IBAN": ["iban", "bank account", "account number", "swift", "bic"],
    "IP_ADDRESS": ["ip", "address", "server", "host", "client ip", "source ip"],
    "API_KEY_AWS": ["aws", "amazon", "access key", "secret key"],
    "API_KEY_OPENAI": ["openai", "api key", "api_key", "token"],
    "API_KEY_STRIPE": ["stripe", "payment", "api key"],
    "API_KEY_GITHUB": ["github", "token", "pat", "personal access"],
}
REDUCERS = {
    "PHONE_NUMBER": ["version", "v.", "model", "code", "id:", "order"],
    "DATE_OF_BIRTH": [
        "created", "updated", "modified", "timestamp", "published",
        "released", "version", "deadline",
    ],
    "IP_ADDRESS": ["version", "v4", "v6", "protocol"],
    "PASSPORT_NUMBER": ["serial", "model", "part", "sku", "order"],
}
LABEL_PATTERN = r"(?:ssn|email|phone|card|iban|dob|passport|license|mrn|ip)\s*[:=]"

# Policy defaults.
DEFAULT_STRATEGY = "redact"
DEFAULT_THRESHOLD = 0.7
DEFAULT_SOURCE = "unknown"
SKIP_ACTION = "skip"

# Masking formats.
REDACT_TEMPLATE = "<{entity_type}_REDACTED>"
HASH_LENGTH = 16
TOKEN_PREFIX = "__SHIELD_"
TOKEN_PATTERN = r"__SHIELD_(?:[\p{L}\p{N}-]+_)+[0-9]{6,}__"
PSEUDO_FORMATS = {
    "EMAIL": "user_%04d@anon.example",
    "PHONE_NUMBER": "+1-555-000-%04d",
    "SSN": "000-00-%04d",
    "CREDIT_CARD": "4000-0000-0000-%04d",
    "ORGANIZATION": "Organization_%d",
    "LOCATION": "%d Anon Street, Anytown",
    "ADDRESS": "%d Anon Street, Anytown",
}
PSEUDO_NAMES = ["Alice", "Bob", "Carol", "Dave", "Eve", "Frank", "Grace"]
PSEUDO_JWT = "eyJmYWtl.eyJmYWtl.ZmFrZV9zaWduYXR1cmU"
PSEUDO_KEY_TYPES = ("API_KEY_AWS", "API_KEY_OPENAI", "API_KEY_STRIPE", "API_KEY_GITHUB")
PSEUDO_KEY_PREFIX = "FAKE_KEY_"
PSEUDO_KEY_LENGTH = 16
PSEUDO_SEED = 42

# Types reported as severe, by alerts and by the event feed.
ALERT_HIGH = (
    "SSN", "CREDIT_CARD", "MEDICAL_ID", "MEDICAL_CONDITION", "PASSPORT_NUMBER",
    "API_KEY_AWS", "API_KEY_OPENAI", "API_KEY_STRIPE", "API_KEY_GITHUB", "JWT_TOKEN",
)
FEED_HIGH = (
    "SSN", "CREDIT_CARD", "MEDICAL_ID", "API_KEY_AWS", "API_KEY_OPENAI",
    "PASSPORT_NUMBER", "JWT_TOKEN",
)
ALERT_EVENT = "high_severity"

# Report and metric windows.
RECENT_EVENTS = 100
LATENCY_WINDOW = 1000
PERCENTILES = (50, 95, 99)
