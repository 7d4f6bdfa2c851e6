"""Fixed patterns of the privacy scan."""

from auditlake.functions.markup import JS_SPACE

# Path parts that mark a private area.
PRIVATE_AREAS = [
    "admin",
    "account",
    "login",
    "logout",
    "signin",
    "signup",
    "checkout",
    "cart",
    "payment",
    "private",
    "preview",
    "staging",
    "token",
    "session",
    "oauth/callback",
    "api/internal",
]
PRIVATE_PATHS = [f"(?i:/{area}(?:/|$))" for area in PRIVATE_AREAS]
# Shapes of secrets.
SECRET_SHAPES = [
    r"(?i:(?:api[_-]?key|secret|token|password)=\w{12,})",
    r"(?i:(?:^|[?&])redacted_sensitive_query=1(?:&|$))",
    r"sk-[A-Za-z0-9_-]{20,}",
    r"gh[pousr]_[A-Za-z0-9_]{20,}",
    r"xox[baprs]-[A-Za-z0-9-]{20,}",
]
# The same areas behind one slash: a single scan instead of one per area.
PRIVATE_ANY = "|".join(["(?i:/(?:" + "|".join(PRIVATE_AREAS) + ")(?:/|$))", *SECRET_SHAPES])
SECRET_ANY = "|".join(SECRET_SHAPES)
URL_IN_TEXT = "(?i)https?://[^" + JS_SPACE + r"""\"'<>),]+"""
ASSIGNMENT = (
    r"(?i)\b(api[_-]?key|secret|password|token)[" + JS_SPACE + "]*[:=][" + JS_SPACE + r"""]*[\"']?[^\"'&""" + JS_SPACE + "]{8,}"
)
# Query keys whose value is never published.
SENSITIVE_KEYS = [
    "access_token",
    "api_key",
    "apikey",
    "auth",
    "authorization",
    "code",
    "key",
    "password",
    "refresh_token",
    "secret",
    "session",
    "session_id",
    "sid",
    "token",
]
# Terms that need an owner's approval (plain substrings).
APPROVAL_TERMS = [
    "ai training",
    "ai input",
    "crawler policy",
    "noindex",
    "index/noindex",
    "canonical strategy",
    "auth",
    "oauth",
    "payment",
    "checkout",
    "mcp mutation",
    "mutating mcp",
    "product price",
    "opening hours",
    "address",
    "phone",
]
APPROVAL_ANY = "|".join(APPROVAL_TERMS)
# Claims that need a reviewer, besides the approval terms.
CLAIM_WORDS = (
    r"\b(best|#1|number one|guarantee|guaranteed|certified|revenue|award-winning|official partner|trusted by"
    r"|customers include|clients include)\b"
)
REVIEW_APPROVAL = "(?i)" + APPROVAL_ANY + "|" + CLAIM_WORDS
# Markers of a reference that carries a secret.
SECRET_REFERENCE = r"(?i:(?:token|api_key|apikey|secret|password)=)|^(?:sk-|gh[pousr]_|xox)"
# Credentials that must not reach a published artifact.
CREDENTIAL_LEAK = r"AIza[0-9A-Za-z_-]{20,}|Bearer\s+[0-9A-Za-z._-]+"
# Local paths cut from exports.
_REST = "[^" + JS_SPACE + r"""\"')<>,]+"""
LOCAL_PATHS = [
    ("/Users/[A-Za-z0-9._-]+/" + _REST, "[redacted-local-path]"),
    ("/home/[A-Za-z0-9._-]+/" + _REST, "[redacted-local-path]"),
    (r"[A-Za-z]:\\Users\\[A-Za-z0-9._-]+\\" + _REST, "[redacted-local-path]"),
]
EXPORT_URL = "https?://" + _REST
