"""Word lists and patterns the mining steps look for.

Every pipeline takes its lists as parameters; the values below are the defaults.
Regular expressions are written in Python's dialect and turned into Java's by
:func:`corpuslens.functions.patterns.java_regex`.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# These must stay exactly as they are for results to agree.
# --------------------------------------------------------------------------

# Topic keyword lists, in topic order; keywords count as plain substrings.
TOPICS: dict[str, list[str]] = {
    "pricing": [
        "price", "pricing", "cost", "rate", "rates", "charge", "fee", "fees", "cash pay",
        "cash-pay", "cash based", "out of pocket", "oop", "eval", "evaluation", "follow up",
        "follow-up", "followup", "package", "packages", "membership", "subscription",
        "per session", "per visit", "per hour", "/hr", "hourly", "what do you charge",
        "how much", "billing",
    ],
    "legal_compliance": [
        "legal", "compliance", "hipaa", "ada", "liability", "malpractice",
        "insurance requirement", "license", "licensing", "regulations", "medicare",
        "medicaid", "pllc", "llc", "s-corp", "s corp", "lawyer", "attorney", "contract",
        "lawsuit", "sued", "audit", "npi", "ein", "business entity", "incorporation",
    ],
    "marketing_first_clients": [
        "first client", "first patients", "getting started", "starting out", "new practice",
        "launch", "opening", "grand opening", "build caseload", "fill schedule",
        "grow practice", "patient acquisition", "marketing", "advertis", "facebook ads",
        "google ads", "seo", "social media", "instagram", "content", "blog", "website",
    ],
    "referrals_physicians": [
        "referral", "referrals", "physician", "doctor", "md", "do ", "primary care", "pcp",
        "orthopedic", "ortho", "specialist", "direct access", "self-refer", "script",
        "prescription", "networking", "relationship", "lunch and learn",
    ],
    "tech_stack": [
        "emr", "ehr", "software", "app", "scheduling", "intake", "payment processing",
        "stripe", "square", "venmo", "paypal", "telehealth", "video", "zoom", "jane app",
        "practice better", "hint health", "healthie", "simple practice", "intakeq",
        "google workspace", "slack", "notion", "asana", "trello",
    ],
    "ceu_courses_certs": [
        "ceu", "ceus", "continuing education", "course", "courses", "certification",
        "certificate", "certified", "credential", "ocs", "scs", "faaompt", "dry needling",
        "idn", "trigger point", "manual therapy", "manipulation", "thrust", "mckenzie", "mdt",
        "pelvic", "vestibular", "concussion", "sports", "orthopedic", "naiomt", "maitland",
        "mulligan", "iastm", "graston", "cupping",
    ],
    "embedded_in_gym": [
        "gym", "crossfit", "fitness", "trainer", "personal training", "box", "strength",
        "conditioning", "weightlifting", "powerlifting", "athletic", "sports performance",
        "embedded", "on-site", "onsite", "co-located", "rent space", "sublease", "gym owner",
    ],
    "scaling_hiring": [
        "hire", "hiring", "employee", "contractor", "1099", "w2", "w-2", "scale", "scaling",
        "grow", "growth", "expand", "expansion", "staff", "staffing", "team", "associate",
        "partner", "partnership", "multiple locations", "second location", "franchise",
    ],
    "failures_burnout": [
        "fail", "failed", "failure", "mistake", "regret", "lesson learned", "burnout",
        "burned out", "burnt out", "stress", "overwhelm", "quit", "quitting", "closing",
        "close practice", "give up", "struggle", "struggling", "hard time", "difficult",
        "challenge", "work life balance", "work-life",
    ],
}

# Entity patterns. Credentials are searched in upper-cased text, the other two
# families in the text as written, ignoring case.
CREDENTIAL_PATTERNS: list[str] = [
    r"\bOCS\b", r"\bSCS\b", r"\bNCS\b", r"\bCCS\b", r"\bGCS\b", r"\bWCS\b", r"\bPCS\b",
    r"\bFAAOMPT\b", r"\bCOPT\b", r"\bCMPT\b", r"\bCIMT\b", r"\bDAAPT\b", r"\bDPT\b",
    r"\bMPT\b", r"\bPT\b", r"\bPTA\b", r"\bATC\b", r"\bCSCS\b", r"\bDN\b", r"\bIDN\b",
    r"\bFDN\b",
]
PROVIDER_PATTERNS: list[str] = [
    r"NAIOMT", r"APTA", r"Herman\s*&?\s*Wallace", r"EIM", r"Institute of Physical Art",
    r"Maitland", r"Mulligan", r"McKenzie\s+Institute", r"MDT", r"OPTP", r"AAOMPT",
    r"Functional Movement", r"FMS", r"SFMA", r"Dry\s*Needling", r"Myopain", r"Integrative",
    r"Evidence in Motion", r"UW\s+Sports",
]
SOFTWARE_PATTERNS: list[str] = [
    r"Jane\s*App", r"Jane\s+Health", r"Practice\s*Better", r"Hint\s*Health", r"Healthie",
    r"Simple\s*Practice", r"IntakeQ", r"WebPT", r"Clinicient", r"Kareo", r"Prompt",
    r"BetterPT", r"Heno", r"OptimisPT", r"TheraOffice", r"Stripe", r"Square", r"PayPal",
    r"Venmo", r"QuickBooks", r"Wave", r"Calendly", r"Acuity", r"Google\s*Workspace", r"Zoom",
    r"Notion",
]

# Patterns that mark a thread as worth a look for marketing copy (ignoring case).
MARKETING_PATTERNS: list[str] = [
    r"swipe", r"script", r"objection", r"elevator pitch", r"value proposition",
    r"call to action", r"cta", r"testimonial", r"case study", r"before.{1,10}after",
    r"referral", r"word of mouth", r"review", r"google review", r"social proof", r"offer",
    r"discount", r"promo", r"free consult", r"discovery call", r"email sequence", r"funnel",
    r"landing page", r"lead magnet", r"pain point", r"transformation", r"outcome", r"result",
]

# Amounts of money, searched in lower-cased text: dollar amount, dollar range,
# "X to Y", "X/hr", "X per hour", "X per session" or "visit".
MONEY_PATTERNS: list[str] = [
    r"\$\s*(\d{1,4}(?:\.\d{1,2})?)",
    r"\$\s*(\d{1,4})\s*[-–—]\s*\$?\s*(\d{1,4})",
    r"(\d{1,4})\s*to\s*(\d{1,4})\s*(?:dollars?)?",
    r"(\d{1,4})\s*/\s*hr",
    r"(\d{1,4})\s+per\s+hour",
    r"(\d{1,4})\s+per\s+(?:session|visit)",
]

# Words near an amount that say what it pays for.
MONEY_CONTEXT: dict[str, list[str]] = {
    "eval": ["eval", "evaluation", "initial", "new patient", "assessment"],
    "followup": ["follow up", "follow-up", "followup", "subsequent", "return"],
    "session": ["session", "visit", "appointment", "treatment"],
    "hour": ["hour", "hourly", "/hr", "per hour"],
    "package": ["package", "packages", "bundle"],
    "membership": ["membership", "monthly", "subscription"],
    "cash": ["cash", "cash pay", "cash-pay", "out of pocket", "oop"],
}

# Query words that carry no meaning for retrieval.
STOP_WORDS: list[str] = [
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have",
    "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must",
    "shall", "can", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into",
    "through", "during", "before", "after", "above", "below", "it", "its", "this", "that", "these",
    "those", "what", "which", "who", "whom", "whose", "when", "where", "why", "how", "all", "each",
    "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "about", "any", "worth", "get", "getting",
]

# Links in a text: up to whitespace, a bracket or a quote, without punctuation at the end.
URL_PATTERN = r"""https?://[^\s<>"')\]]+(?<![.,;:!?)])"""

# Query-string parameters that only track the visitor, and link targets that
# stay inside the forum's own site.
TRACKING_PREFIX = "utm_"
TRACKING_PARAMS: list[str] = ["fbclid", "gclid", "ref", "source"]
OWN_DOMAIN_PREFIXES: list[str] = ["facebook.com", "fb."]

# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


def entity_families(
    credentials: list[str] = CREDENTIAL_PATTERNS,
    providers: list[str] = PROVIDER_PATTERNS,
    software: list[str] = SOFTWARE_PATTERNS,
) -> list[tuple[str, list[str], bool]]:
    """Entity pattern families as ``(category, patterns, search upper-cased text)``."""
    return [
        ("credential", credentials, True),
        ("ceu_provider", providers, False),
        ("software", software, False),
    ]
