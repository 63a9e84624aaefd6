"""Fixed values of the detection rules: patterns, word lists, severities.

Each entry of a pattern table is (name, severity, pattern, anchors). ``anchors``
holds literals that any match must contain, in lower case, as groups: every
group needs one of its literals in the text before the pattern is tried. They
only save work and never change a result. Literals given by ``_words`` stand in
any match as whole words; all of them are found in one pass over the text, so
they cost no search each. Very common words are left out where others decide.
"""

from __future__ import annotations

from dataclasses import dataclass


class Word(str):
    """An anchor with no word character on either side."""


def _words(*literals: str) -> tuple[Word, ...]:
    return tuple(map(Word, literals))


@dataclass(frozen=True)
class Pattern:
    name: str
    severity: float
    regex: str
    anchors: tuple[tuple[str, ...], ...]
    confidence: float
    content_chars: int | None = None
    ignore_case: bool = True
    scan: str | None = None


@dataclass(frozen=True)
class PatternRule:
    rule_id: str
    tier: str
    patterns: tuple[Pattern, ...]
    outside_fences: bool = False


def _rule(rule_id, tier, title, confidence, rows, content_chars=None, outside_fences=False, named=True):
    patterns = tuple(
        Pattern(f"{title}: {name}" if named else title, severity, regex, anchors, confidence, content_chars, scan=SCANS.get(regex))
        for name, severity, regex, anchors in rows
    )
    return PatternRule(rule_id, tier, patterns, outside_fences)


# Patterns that run to a far delimiter would be tried again from every start inside the same run. Each is searched
# with a wider pattern that takes the run whole, once, and the runs that match exactly are kept: the same matches in
# linear time.
_CHAIN = r"[^&;]*+(?:[&;]++(?:[^&;]*\b(?:{0})\b)?+)?+"
SCANS = {
    r"\bcurl\b[^|]*\|\s*(?:ba)?sh\b": r"\bcurl\b[^|]*+(?:\|(?:\s*(?:ba)?sh\b)?+)?+",
    r"\bwget\b[^|]*\|\s*(?:ba)?sh\b": r"\bwget\b[^|]*+(?:\|(?:\s*(?:ba)?sh\b)?+)?+",
    r"\bgit\s+clone\b[^&;]*[&;]+[^&;]*\b(?:npm\s+(?:install|start|run)|node\s+|python\s+|\./)\b":
        r"\bgit\s+clone\b" + _CHAIN.format(r"npm\s+(?:install|start|run)|node\s+|python\s+|\./"),
    r"\bnpm\s+install\b[^&;]*[&;]+[^&;]*\b(?:npm\s+(?:start|run)|node\s+|npx\s+)\b":
        r"\bnpm\s+install\b" + _CHAIN.format(r"npm\s+(?:start|run)|node\s+|npx\s+"),
    r"data:\s*[^;]+;\s*base64\s*,": r"data:[^;]++(?:;(?:\s*base64\s*,)?+)?+",
}
TAG_SCAN = r"<\s*(?:script|iframe|object|embed|form|input|svg|link|meta|base)\b[^>]*+>?+"
MARKDOWN_LINK_SCAN = r"\[[^\]]*+(?:\](?:\([^)]++\)?+)?+)?+"

STRUCTURAL, CONTEXTUAL, THREAT_INTEL = "structural", "contextual", "threat-intel"

# ---- Fixed values: structural rules --------------------------------------

DANGEROUS_TAGS = ("script", "iframe", "object", "embed", "form", "input", "svg", "link", "meta", "base")

HTML_INJECTION = PatternRule("STRUCT-003", STRUCTURAL, (
    Pattern("HTML/Script Injection", 0.90,
            r"<\s*(?:script|iframe|object|embed|form|input|svg|link|meta|base)\b[^>]*>",
            (("<",), _words(*DANGEROUS_TAGS)), 0.95, 80, scan=TAG_SCAN),
    Pattern("HTML Event Handler", 0.85, r"""\bon\w+\s*=\s*["'][^"']*["']""", (("=",), ('"', "'"), ("on",)), 0.90, 80),
))

SCRIPT_URIS = _rule("STRUCT-004", STRUCTURAL, "JavaScript URI", 0.95, (
    ("", 0.95, r"j\s*a\s*v\s*a\s*s\s*c\s*r\s*i\s*p\s*t\s*:", ((":",), ("j",), ("v",))),
    ("", 0.95, r"v\s*b\s*s\s*c\s*r\s*i\s*p\s*t\s*:", ((":",), ("v",), ("b",))),
), named=False)

DATA_URIS = _rule("STRUCT-008", STRUCTURAL, "Data URI", 0.90, (
    ("", 0.85, r"data:\s*[^;]+;\s*base64\s*,", ((";",), (",",), ("base64",), ("data:",))),
), named=False)

_WHITE = r"(?:#fff(?:fff)?|white|rgb\(\s*255\s*,\s*255\s*,\s*255\s*\))"
HIDDEN_TEXT = _rule("STRUCT-009", STRUCTURAL, "Hidden Text (CSS)", 0.80, (
    ("", 0.75, r"display\s*:\s*none", ((":",), ("display",), ("none",))),
    ("", 0.75, r"font-size\s*:\s*0", ((":",), ("font-size",))),
    ("", 0.75, r"opacity\s*:\s*0(?![.])", ((":",), ("opacity",))),
    ("", 0.75, r"visibility\s*:\s*hidden", ((":",), ("visibility",), ("hidden",))),
    ("", 0.75, r"color\s*:\s*" + _WHITE + r"\s*;?\s*background(?:-color)?\s*:\s*" + _WHITE, ((":",), ("background",), ("color",))),
    ("", 0.75, r"height\s*:\s*0[^0-9]", ((":",), ("height",))),
    ("", 0.75, r"overflow\s*:\s*hidden", ((":",), ("overflow",), ("hidden",))),
), named=False)

MARKDOWN_LINK = r"\[([^\]]*)\]\(([^)]+)\)"
SCRIPT_OR_DATA_URL = "javascript:|data:"
SUSPICIOUS_URL = r"javascript:|data:|\|\s*(?:bash|sh)|[;&|`$]|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

SUSPICIOUS_DECODED = (
    r"\b(?:bash|sh|curl|wget|chmod|rm\s|python|node|exec|eval|powershell)\b",
    r"\b(?:ignore|override|system|instruction|prompt)\b",
    r"<script",
    r"\|\s*(?:bash|sh)\b",
)

LATIN, CYRILLIC_OR_GREEK = "[a-zA-Z]", r"[\x{0370}-\x{03FF}\x{0400}-\x{04FF}]"
DOUBLE_ENCODED = "%25[0-9A-Fa-f]{2}"
HTML_ENTITY = r"&(?:#\d{2,4}|#x[0-9a-fA-F]{2,4}|[a-zA-Z]+);"
DOUBLE_ENCODED_MIN, HTML_ENTITY_MIN = 3, 10

# ---- Fixed values: contextual rules ---------------------------------------

OVERRIDE_VERBS = (
    "ignore", "disregard", "forget", "override", "bypass", "skip", "discard", "dismiss", "abandon", "drop",
)
OVERRIDE_MODIFIERS = (
    "all", "any", "every", "the", "your", "previous", "prior", "above", "existing", "current", "original",
    "initial", "old",
)
OVERRIDE_NOUNS = (
    "instructions", "instruction", "prompt", "rules", "commands", "guidelines", "constraints", "directives",
    "policies", "restrictions", "safeguards", "safety", "system prompt", "programming", "training", "context",
    "protocols",
)
OVERRIDE_WINDOW = 60

IMPERATIVE_VERBS = (
    "execute", "run", "open", "access", "delete", "read", "write", "create", "send", "call", "invoke", "start",
    "launch", "spawn", "modify", "remove", "install", "fetch", "get", "load",
)
SYSTEM_NOUNS = (
    "file", "files", "terminal", "shell", "command", "system", "api", "code", "server", "database", "directory",
    "process", "endpoint", "registry", "service", "function", "script", "binary", "executable", "program", "tool",
    "plugin", "module", "contents",
)
IMPERATIVE_REACH = 5

SHELL_COMMANDS = _rule("CTX-003", CONTEXTUAL, "Shell Command", 0.85, (
    ("curl pipe shell", 0.90, r"\bcurl\b[^|]*\|\s*(?:ba)?sh\b", (_words("curl"), _words("sh", "bash"), ("|",))),
    ("wget pipe shell", 0.90, r"\bwget\b[^|]*\|\s*(?:ba)?sh\b", (_words("wget"), _words("sh", "bash"), ("|",))),
    ("rm -rf", 0.85, r"\brm\s+-(?:r|f|rf|fr)\b", (_words("rm"), ("-r", "-f"))),
    ("chmod +x", 0.70, r"\bchmod\s+\+x\b", (_words("chmod"), ("+x",))),
    ("sudo command", 0.75, r"\bsudo\s+\w+", (_words("sudo"),)),
    ("PowerShell encoded", 0.90,
     r"\bpowershell\s+-(?:enc|encodedcommand|e|ep|nop|nologo|noprofile|windowstyle)\b", (_words("powershell"),)),
    ("python -c", 0.75, r"""\bpython\s+-c\s+['"]""", (_words("python"), ("-c",))),
    ("node -e", 0.75, r"""\bnode\s+-e\s+['"]""", (_words("node"), ("-e",))),
    ("eval()", 0.80, r"\beval\s*\(", (_words("eval"), ("(",))),
    ("etc file redirect", 0.90, r">\s*/etc/(?:passwd|shadow|hosts)", (("/etc/",), (">",))),
    ("netcat listener", 0.85, r"\b(?:nc|ncat|netcat)\s+-[lp]", (_words("nc", "ncat", "netcat"), ("-l", "-p"))),
    ("base64 decode", 0.70, r"\bbase64\s+(?:-d|--decode)\b", (_words("base64"), ("-d", "--decode"))),
    ("git clone + execute chain", 0.85,
     r"\bgit\s+clone\b[^&;]*[&;]+[^&;]*\b(?:npm\s+(?:install|start|run)|node\s+|python\s+|\./)\b",
     (_words("git"), _words("clone"), ("&", ";"))),
    ("npm install + execute chain", 0.80,
     r"\bnpm\s+install\b[^&;]*[&;]+[^&;]*\b(?:npm\s+(?:start|run)|node\s+|npx\s+)\b",
     (_words("npm"), _words("install"), ("&", ";"))),
), content_chars=80, outside_fences=True)

_tool_rows = _rule("CTX-004", CONTEXTUAL, "Tool Call Syntax", 0.90, (
    ("MCP tool invocation", 0.90, r"\buse_mcp_tool\b", (_words("use_mcp_tool"),)),
    ("tool_call XML tag", 0.85, r"<tool_call>", (_words("tool_call"),)),
    ("tool_call closing tag", 0.85, r"</tool_call>", (_words("tool_call"),)),
    ("function_call XML tag", 0.85, r"<function_call>", (_words("function_call"),)),
    ("tool_use XML tag", 0.85, r"<tool_use>", (_words("tool_use"),)),
    ("function_call syntax", 0.80, r"\bfunction_call\s*[:(]", (_words("function_call"),)),
    ("tool_use syntax", 0.80, r"\btool_use\s*[:(]", (_words("tool_use"),)),
))
TOOL_CALLS = PatternRule("CTX-004", CONTEXTUAL, _tool_rows.patterns + (
    Pattern("Tool Call Syntax: JSON tool structure", 0.80,
            r'\{\s*"(?:tool|function|name)"\s*:\s*"[^"]+"\s*,\s*"(?:arguments|input|parameters|params)"\s*:',
            (("{",), ('"tool"', '"function"', '"name"'), ('"arguments"', '"input"', '"parameters"', '"params"')),
            0.85, 100),
))

ROLE_ASSUMPTION = _rule("CTX-005", CONTEXTUAL, "Role Assumption", 0.80, (
    ("", 0.70, r"\byou\s+are\s+now\b", (_words("now"),)),
    ("", 0.55, r"\bact\s+as\s+(?:a\s+|an\s+)?", (_words("act"),)),
    ("", 0.75, r"\byour\s+new\s+role\b", (_words("role"),)),
    ("", 0.85, r"\benter\s+(?:developer|admin|debug|root|sudo|god)\s+mode\b", (_words("enter"), _words("mode"))),
    ("", 0.65, r"\bpretend\s+(?:to\s+be|you\s+are)\b", (_words("pretend"),)),
    ("", 0.75, r"\bfrom\s+now\s+on\s+you\s+are\b", (_words("now"),)),
    ("", 0.70, r"\byou\s+(?:must|should|will)\s+now\s+(?:act|behave|respond|operate)\b",
     (_words("now"), _words("act", "behave", "respond", "operate"))),
    ("", 0.60, r"\bswitch\s+to\s+(?:\w+\s+)?mode\b", (_words("switch"), _words("mode"))),
    ("", 0.80, r"\byou\s+have\s+been\s+(?:upgraded|reprogrammed|updated|reconfigured)\b", (_words("upgraded", "reprogrammed", "updated", "reconfigured"),)),
    ("", 0.75, r"\bforget\s+(?:that\s+)?you\s+are\b", (_words("forget"),)),
), named=False)

OUTPUT_MANIPULATION = _rule("CTX-006", CONTEXTUAL, "Output Manipulation", 0.75, (
    ("", 0.55, r"\b(?:output|return|respond|reply|print|show|display)\s+(?:only|just|exclusively|solely)\b",
     (_words("only", "just", "exclusively", "solely"),
      _words("output", "return", "respond", "reply", "print", "show", "display"))),
    ("", 0.70, r"\bdo\s+not\s+(?:include|add|show|display|mention)\s+(?:any\s+)?"
     r"(?:warning|notice|annotation|safety|explanation|preamble)", (_words("include", "add", "show", "display", "mention"), (
         "warning", "notice", "annotation", "safety", "explanation", "preamble"))),
    ("", 0.65, r"\brespond\s+with\s+(?:only|just)\s+(?:the\s+)?(?:raw|plain|unfiltered|exact|original)\b",
     (_words("respond"), _words("raw", "plain", "unfiltered", "exact", "original"))),
    ("", 0.75, r"\bstrip\s+(?:all\s+)?(?:warning|safety|security|annotation)", (_words("strip"),)),
    ("", 0.65, r"\bdo\s+not\s+(?:filter|sanitize|redact|modify|censor)\b", (_words(
        "filter", "sanitize", "redact", "modify", "censor"),)),
    ("", 0.60, r"\braw\s+(?:and\s+)?unfiltered\s+(?:output|response|data|content)\b", (_words("unfiltered"),)),
), named=False)

_urgency_rows = _rule("CTX-007", CONTEXTUAL, "Urgency / Authority", 0.75, (
    ("", 0.70, r"\b(?:critical|urgent)\s+system\s+(?:update|message|alert|notice|override)\b",
     (_words("critical", "urgent"), _words("system"))),
    ("", 0.75, r"\badmin(?:istrator)?\s+override\b", (_words("admin", "administrator"), _words("override"))),
    ("", 0.75, r"\bthis\s+is\s+(?:your|the)\s+(?:developer|administrator|admin|system|creator|owner)\b",
     (_words("developer", "administrator", "admin", "system", "creator", "owner"),)),
    ("", 0.70, r"\bauthorized\s+(?:by|from)\s+(?:the\s+)?(?:admin|developer|system|Anthropic|OpenAI)\b",
     (_words("authorized"),)),
    ("", 0.70, r"\bsystem\s+(?:level\s+)?(?:override|command|directive)\b",
     (_words("system"), _words("override", "command", "directive"))),
    ("", 0.50, r"\bpriority\s*:\s*(?:highest|critical|p0|urgent)\b", (_words("priority"),)),
    ("", 0.65, r"\b(?:do\s+this\s+)?immediately\s+(?:without|before)\s+(?:checking|verifying|asking|confirming)",
     (_words("immediately"), _words("without", "before"))),
), named=False)
URGENCY = PatternRule("CTX-007", CONTEXTUAL, (
    Pattern("Urgency / Authority", 0.55, r"\b(?:URGENT|CRITICAL|EMERGENCY|IMMEDIATE)\s*(?::|!|-)\s*",
            (_words("urgent", "critical", "emergency", "immediate"), (":", "!", "-")), 0.75, None, ignore_case=False),
) + _urgency_rows.patterns)


def npx_pattern(trusted: tuple[str, ...] = ()) -> str:
    """``npx`` runs, except ``npx -y`` of packages the operator trusts."""
    exempt = "".join(rf"(?!-y\s+{name})" for name in trusted)
    return rf"\bnpx\s+{exempt}\S+"


def payload_delivery(trusted: tuple[str, ...] = ()) -> PatternRule:
    return _rule("CTX-008", CONTEXTUAL, "Payload Delivery", 0.80, (
        ("download instruction", 0.75,
         r"\b(?:download|fetch|retrieve|grab|pull)\s+(?:the\s+)?"
         r"(?:file|script|payload|binary|package|code)\s+(?:from|at)\b",
         (_words("download", "fetch", "retrieve", "grab", "pull"),
          _words("file", "script", "payload", "binary", "package", "code"))),
        ("curl URL", 0.70, r"\bcurl\b[^;\n&]{0,80}https?://", (_words("curl"), ("http",))),
        ("wget URL", 0.70, r"\bwget\b[^;\n&]{0,80}https?://", (_words("wget"), ("http",))),
        ("pip install", 0.60, r"\bpip\s+install\s+(?:--user\s+)?(?!-r\b)\S+", (_words("pip"), _words("install"))),
        ("npm install -g", 0.65, r"\bnpm\s+install\s+(?:-g\s+)\S+", (_words("npm"), _words("install"), ("-g",))),
        ("npm install package", 0.55, r"\bnpm\s+install\s+(?!-[dD])\S+", (_words("npm"), _words("install"))),
        ("npx execution", 0.60, npx_pattern(trusted), (_words("npx"),)),
        ("PowerShell IEX", 0.90, r"\biex\s*\(\s*(?:new-object|invoke-webrequest|iwr)\b", (_words("iex"), ("(",))),
        ("PowerShell Invoke", 0.80, r"\bInvoke-(?:Expression|WebRequest|RestMethod)\b", (_words("invoke"), _words("expression", "webrequest", "restmethod"))),
        ("Python system import", 0.65, r"\bimport\s+(?:os|subprocess|sys|shutil|ctypes)\b", (_words("import"), _words("os", "subprocess", "sys", "shutil", "ctypes"))),
        ("git clone", 0.70, r"\bgit\s+clone\s+\S+", (_words("git"), _words("clone"))),
        ("npm run/start", 0.60, r"\bnpm\s+(?:run|start|exec)\s+\S+", (_words("npm"), _words("run", "start", "exec"))),
        ("yarn/pnpm run", 0.60, r"\b(?:yarn|pnpm)\s+(?:run|start|exec|dlx)\s+\S+", (_words("yarn", "pnpm"),)),
        ("go install", 0.60, r"\bgo\s+install\s+\S+", (_words("install"),)),
        ("cargo install", 0.60, r"\bcargo\s+install\s+\S+", (_words("cargo"), _words("install"))),
        ("gem install", 0.60, r"\bgem\s+install\s+\S+", (_words("gem"), _words("install"))),
        ("composer require", 0.60, r"\bcomposer\s+require\s+\S+", (_words("composer"), _words("require"))),
        ("docker run/pull", 0.65, r"\bdocker\s+(?:run|pull)\s+\S+", (_words("docker"), _words("run", "pull"))),
    ), content_chars=80, outside_fences=True)


SENSITIVE_PATHS = _rule("CTX-009", CONTEXTUAL, "Sensitive File Path", 0.85, (
    ("SSH key path", 0.75, r"~/\.ssh/(?:id_rsa|id_ed25519|authorized_keys|config)\b", (("~/.ssh/",),)),
    ("AWS credentials path", 0.75, r"~/\.aws/(?:credentials|config)\b", (("~/.aws/",),)),
    ("credential file path", 0.70, r"~/\.(?:env|netrc|pgpass|my\.cnf)\b", (("~/.",),)),
    ("system credential file", 0.80, r"/etc/(?:passwd|shadow|sudoers)\b", (("/etc/",),)),
    ("shell history path", 0.65, r"~/\.(?:bash_history|zsh_history)\b", (("~/.",),)),
    ("GPG keyring path", 0.70, r"~/\.gnupg/", (("~/.gnupg/",),)),
))

# ---- Fixed values: weighting and threat-intel ------------------------------

EXTERNAL_WEIGHT = 1.4
FIELD_WEIGHTS = {"description": 1.2, "attendee_name": 1.3}
THREAT_RULE, THREAT_NAME = "THREAT-001", "Known Threat Hash"
REPORT_BONUS, REPORT_BONUS_MAX = 0.02, 0.15
