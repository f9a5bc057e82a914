"""The rule catalogue: what each span rule matches, and how its findings are graded."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    name: str
    type: str
    scanner: str
    severity: str
    pattern: str
    action: str = "block"
    confidence: float = 1.0
    details: str | None = None

    @property
    def needs(self) -> tuple[str, ...]:
        """Lower-case strings one of which every match holds; none: unknown."""
        return NEEDS.get(self.name) or (tuple(w for w in KEYWORDS if w in self.pattern)[:1] if self.name == "sensitive_keyword" else ())


SEVERITIES = ["info", "low", "medium", "high", "critical"]
ACTIONS = ["allow", "warn", "redact", "ask", "block", "quarantine"]

# The patterns, words, limits and grades below decide what counts as a finding.
_SECRETS = [
    ("private_key_block", "critical", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("aws_access_key_id", "critical", r"\bAKIA[0-9A-Z]{16}\b"),
    ("aws_secret_access_key", "critical", r"(?i)\baws_secret_access_key\b\s*[:=]\s*['\"]?[A-Za-z0-9/+=]{20,}['\"]?"),
    ("stripe_secret_key", "critical", r"\bsk_(?:live|test)_[A-Za-z0-9]{10,}"),
    ("database_url", "critical", r"(?i)\b(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|redis|amqp)://[^\s'\"]+"),
    ("bearer_token", "critical", r"(?i)\bbearer\s+[A-Za-z0-9._~+/=-]{16,}"),
    ("generic_secret_assignment", "high", r"(?i)\b(?:api[_-]?key|secret|token|password|passwd|pwd)\b\s*[:=]\s*['\"]?[^\s'\"]{8,}['\"]?"),
]
_PII = [
    ("email_address", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("phone_number_india", r"(?<!\d)(?:\+91[- ]?|0)?[6-9]\d{4}[- ]?\d{5}(?!\d)"),
    ("account_identifier", r"(?i)\b(account|acct|customer|patient|invoice|order)[ _-]?(id|number|no)?\b\s*[:=]\s*['\"]?[A-Za-z0-9_-]{6,}['\"]?"),
]
KEYWORDS = ["aadhaar", "pan", "ssn", "social security", "salary", "medical", "diagnosis", "patient", "confidential"]
_INJECTION = [
    ("ignore_instructions", "critical", r"(?i)ignore\s+(all\s+|any\s+)?(previous|prior|above)\s+instructions"),
    ("disregard_instructions", "critical", r"(?i)disregard\s+(all\s+|any\s+)?(previous|prior|above)\s+instructions"),
    ("read_env", "critical", r"(?i)\b(read|cat|print|reveal|show|include)\b[^\n]{0,80}\.env\b"),
    ("read_ssh", "critical", r"(?i)\b(read|cat|print|reveal|show|include)\b[^\n]{0,80}\.ssh\b"),
    ("reveal_environment_variables", "critical", r"(?i)\b(reveal|show|print|include)\b[^\n]{0,80}\benvironment variables\b"),
    ("network_exfiltration", "critical", r"(?i)\b(curl|wget)\b\s+https?://"),
    ("exfiltration_keywords", "high", r"(?i)\b(send|post|upload|exfiltrate)\b[^\n]{0,80}\b(secret|credential|token|key|password|data)\b"),
    ("override_security_policy", "high", r"(?i)\b(override|bypass|disable)\b[^\n]{0,80}\b(safety|security|policy|guard)\b"),
]
#: Rules that a negation just before the match turns into documentation; characters looked at; the negation.
NEGATABLE = ["ignore_instructions", "disregard_instructions", "read_env", "read_ssh", "reveal_environment_variables", "override_security_policy"]
NEGATION_CHARS = 40
NEGATION = (
    r"(?i)(?:\b(?:never|not|no|don't|doesn't|does\s+not|do\s+not|did\s+not|won't|will\s+not|shouldn't|should\s+not|must\s+not|"
    r"avoid|avoiding|prevent|prevents|refuse|refuses)\b\W+){1,3}$"
)
_GAP = r"(?:(?!\.\s)[^\n])"
_SEMANTIC = [
    ("semantic_credential_request", "high", r"\b(?:send|share|give|provide|paste|print|output|reveal|expose|include|list)\b" + _GAP
     + r"{0,30}\b(?:credential|credentials|password|passwords|api[_\s-]?key|api[_\s-]?keys|secret|secrets|token|tokens)\b"),
    ("semantic_env_dump_request", "high", r"\b(?:list|show|print|output|dump|include|enumerate)\b" + _GAP
     + r"{0,25}\b(?:all\s+)?(?:environment\s+variables?|env\s+vars?|\.env|secrets?|config(?:uration)?\s+values?)\b"),
    ("semantic_external_transfer_intent", "high", r"\b(?:upload|post|send|transmit|exfiltrate|forward|copy)\b" + _GAP
     + r"{0,40}\b(?:to\s+(?:my|our|the|a|an|their)\s+(?:server|endpoint|bucket|webhook|url|host|domain)|externally|offsite|outside\s+the\s+(?:network|org))"),
    ("semantic_security_tampering_intent", "medium", r"\b(?:disable|bypass|turn\s+off|circumvent|skip|remove)\b" + _GAP
     + r"{0,30}\b(?:security|guard|guardrail|firewall|scanner|policy|policies|audit|protection|safeguard)\b"),
]
SEMANTIC_DETAILS = "Heuristic prose pattern. May be documentation; requires review. Not a deterministic detection."
#: Context that reads as documentation, within so many characters; subjects that do so right before one rule's match.
BENIGN = r"(?i)\b(do not|don't|never|avoid|must not|should not|refrain)\b[^.\n]{0,40}\b(commit|paste|share|send|upload|log|reveal|expose|echo|print|include)\b"
BENIGN_CHARS = 120
SUBJECT = r"(?i)(?:^|[\s\"'(])(?:we|they|it|this|that|these|those|the\s+\w+|our\s+\w+|a\s+\w+|an\s+\w+)\s+$"
SUBJECT_RULE, SUBJECT_CHARS = "semantic_env_dump_request", 24
#: Parts of an origin that mark its text as untrusted.
UNTRUSTED = ["repo:", "file:", "readme", "context:", "manifest:"]
_COMMANDS = [
    ("curl", r"\bcurl\b", "high"),
    ("wget", r"\bwget\b", "high"),
    ("netcat", r"\bnc\b", "high"),
    ("scp", r"\bscp\b", "high"),
    ("ssh", r"\bssh\b", "medium"),
    ("git_push", r"\bgit\s+push\b", "high"),
    ("aws_cli", r"\baws\b", "high"),
    ("gcloud_cli", r"\bgcloud\b", "high"),
    ("azure_cli", r"\baz\b", "high"),
    ("kubectl", r"\bkubectl\b", "high"),
    ("cat_env", r"(?i)\bcat\b[^\n]{0,80}\.env\b", "critical"),
    ("cat_ssh", r"(?i)\bcat\b[^\n]{0,80}\.ssh\b", "critical"),
    ("rm_rf", r"\brm\s+-rf\b", "critical"),
    ("chmod_777", r"\bchmod\s+777\b", "medium"),
    ("shutdown", r"\bshutdown\b", "high"),
]
#: Paths that read as holding secrets, noted in a secret finding's details (no effect on its grade).
SENSITIVE_PATH = r"(?i)(^|/)(\.env(\..*)?|[^/]*\.(pem|key)|secrets?/.*|credentials[^/]*)$"

#: What a match can't do without, to pass over texts cheaply.
NEEDS = {
    "private_key_block": ("private key",),
    "aws_access_key_id": ("akia",),
    "aws_secret_access_key": ("aws_secret_access_key",),
    "stripe_secret_key": ("sk_live_", "sk_test_"),
    "database_url": ("://",),
    "bearer_token": ("bearer",),
    "generic_secret_assignment": ("key", "secret", "token", "passw", "pwd"),
    "email_address": ("@",),
    "account_identifier": ("account", "acct", "customer", "patient", "invoice", "order"),
    "ignore_instructions": ("instructions",),
    "disregard_instructions": ("instructions",),
    "read_env": (".env",),
    "read_ssh": (".ssh",),
    "reveal_environment_variables": ("environment variables",),
    "network_exfiltration": ("://",),
    "exfiltration_keywords": ("send", "post", "upload", "exfiltrate"),
    "override_security_policy": ("override", "bypass", "disable"),
    "cat_env": (".env",),
    "cat_ssh": (".ssh",),
}
#: Characters that fold to ASCII letters when case is ignored; texts that hold one are always searched.
FOLDING = "[\u017f\u0131\u0130\u212a]"

SECRETS = [Rule(n, "secret", "secrets", s, p) for n, s, p in _SECRETS]
PII = [Rule(n, "pii", "pii", "medium", p, "redact") for n, p in _PII]
KEYWORD = Rule("sensitive_keyword", "pii", "pii", "low", r"(?i)\b({})\b", "warn", 0.7)
KEYWORD_RULES = [Rule(KEYWORD.name, "pii", "pii", "low", rf"(?i)\b{w}\b", "warn", 0.7) for w in KEYWORDS]
INJECTION = [Rule(n, "prompt_injection", "injection", s, p) for n, s, p in _INJECTION]
SEMANTIC = [Rule(n, "semantic_leak", "semantic_leak", s, "(?i)" + p, "warn", 0.6, SEMANTIC_DETAILS) for n, s, p in _SEMANTIC]
COMMANDS = [Rule(n, "command_guard", "command_guard", s, p) for n, p, s in _COMMANDS]
#: Text rules in reporting order; ties in position keep it.
TEXT_RULES = [*SECRETS, *PII, *KEYWORD_RULES, *INJECTION, *SEMANTIC]
