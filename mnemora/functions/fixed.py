"""Fixed values that results must agree on: word lists, tables, patterns and closed vocabularies."""

# Greek letter pairs, in the order in which they are replaced, then single letters.
GREEK_PAIRS = [
    ("ου", "ou"), ("αυ", "av"), ("ευ", "ev"), ("γγ", "ng"), ("γκ", "gk"),
    ("γχ", "nch"), ("μπ", "b"), ("ντ", "nt"), ("τσ", "ts"), ("τζ", "tz"),
]
GREEK_SINGLES = {
    "α": "a", "β": "v", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "i", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "y", "φ": "f", "χ": "ch", "ψ": "ps", "ω": "o",
}

# Patterns of notes in brackets that are no part of a name.
NAME_NOTES = [
    r"^[Ee]\d{4,}$", r"^\d{1,4}$", r"^.*@.*$", r"^via\s+", "^ΔΙΕΥΘΥΝΤ", "^Διευθύνων", "^Γραμματέας", "^Επικεφαλής",
    "^Head of", "^Director", "^Senior", "^Manager",
]

PERSONAL_DOMAINS = [
    "gmail.com", "hotmail.com", "msn.com", "icloud.com", "yahoo.com", "yahoo.gr", "outlook.com", "live.com",
    "protonmail.com", "mail.com",
]

REPLY_PREFIXES = ["Re", "Fwd", "FW", "Απ", "Πρ"]

TRACKING_PARAMETERS = ["web", "source", "csf", "e", "cid", "nav"]

VIDEO_HOSTS = ["youtu.be", "www.youtube.com", "youtube.com", "m.youtube.com"]

# Closed vocabularies; the first value is the default.
SENTIMENTS = ["informational", "directive", "collaborative", "escalation", "celebratory"]
SESSION_SENTIMENTS = ["productive", "exploratory", "debugging", "planning", "reviewing"]
URGENCIES = ["low", "medium", "high", "critical"]
LANGUAGES = ["english", "greek", "mixed"]

# Records of a session file: those that carry a turn's text, and those that are not looked at.
CONTENT_RECORDS = ["user", "assistant"]
SKIPPED_RECORDS = ["file-history-snapshot", "last-prompt", "progress", "queue-operation"]
# What a turn shows of a tool: its target, its file, or so many characters of its command; characters of a turn.
TOOLS_BY_TARGET = ["Read", "Glob", "Grep"]
TOOLS_BY_FILE = ["Edit", "Write"]
TOOL_BY_COMMAND = "Bash"
COMMAND_SHOWN = 100
TURN_SHOWN = 50_000

# Vector ids by kind: (kind, offset); id = -offset - entity, but e-mails are positive.
VECTOR_KINDS = [("email", 0), ("thread", 10_000_000), ("conversation", 2_000_000), ("attachment", 0)]

MIME_BY_SUFFIX = {
    "pdf": "application/pdf",
    "doc": "application/msword",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "txt": "text/plain", "csv": "text/csv", "html": "text/html", "eml": "message/rfc822",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "ics": "text/calendar",
}

SESSION_GAP_HOURS = 8
RRF_K = 60
FUZZY_THRESHOLD = 0.82
STALE_DEADLINE_DAYS = 180
LINK_ATTEMPTS, LINK_COOL_DAYS = 5, 7
IMAGE_MIN_SIDE, IMAGE_MIN_BYTES, SIGNATURE_SHARE = 100, 5000, 0.05
