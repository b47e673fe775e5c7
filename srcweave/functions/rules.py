"""Patterns and names of the security, payment and data-flow rules, and rules on whole text as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Calls that run SQL, a shell, or touch files by path; properties and calls that write HTML.
SQL_METHODS = ("query", "execute", "raw", "$queryRaw", "$executeRaw", "rawQuery")
COMMAND_METHODS = ("exec", "execSync", "spawn", "spawnSync", "execFile", "execFileSync")
PATH_METHODS = ("readFile", "readFileSync", "writeFile", "writeFileSync", "createReadStream", "createWriteStream", "open", "openSync", "access", "accessSync")
HTML_PROPERTIES = ("innerHTML", "outerHTML")
HTML_METHODS = ("document.write", "document.writeln")
HTML_ATTRIBUTE = "dangerouslySetInnerHTML"
EVAL_FUNCTIONS = ("eval", "Function")
TIMER_FUNCTIONS = ("setTimeout", "setInterval")

#: Hard-coded secrets, as patterns.
SECRETS = (
    r"""(?i)['"](?:api[_-]?key|apikey)['"]\s*[:=]\s*['"][^'"]{16,}['"]""",
    r"""(?i)['"](?:secret|api[_-]?secret)['"]\s*[:=]\s*['"][^'"]{16,}['"]""",
    r"""['"]AKIA[0-9A-Z]{16}['"]""",
    r"""['"]sk_(?:live|test)_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]-----BEGIN (?:RSA |DSA |EC )?PRIVATE KEY-----""",
    r"""(?i)(?:password|passwd|pwd)\s*[:=]\s*['"][^'"]{4,}['"]""",
    r"""['"]eyJ[a-zA-Z0-9_-]*\.eyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]*['"]""",
)

#: Payment calls, where amounts come from, card data and what logs it, keys, calls to make idempotent.
STRIPE_METHODS = ("charges.create", "paymentIntents.create", "paymentIntents.confirm", "checkout.sessions.create", "invoices.create", "subscriptions.create")
ADYEN_METHODS = ("payments", "payments/details", "authorise")
AMOUNT_SOURCES = ("req.body.amount", "request.body.amount", "body.amount", "params.amount", "query.amount", "data.amount")
CARD_FIELDS = (
    "cardNumber", "card_number", "cardnumber", "cvv", "cvc", "cvv2", "cvc2", "securityCode", "security_code", "pan",
    "primaryAccountNumber", "primary_account_number", "expiry", "expiryDate", "expiry_date", "expirationDate",
    "expiration_date", "cardholderName", "cardholder_name",
)
LOG_FUNCTIONS = (
    "console.log", "console.info", "console.debug", "console.warn", "console.error", "logger.log", "logger.info",
    "logger.debug", "logger.warn", "logger.error", "log.info", "log.debug", "log.error", "winston.info",
    "winston.debug", "winston.error",
)
PAYMENT_KEYS = (
    r"""['"]sk_live_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]sk_test_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]pk_live_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]pk_test_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]rk_live_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]rk_test_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]whsec_[a-zA-Z0-9]{24,}['"]""",
    r"""['"]AQE[a-zA-Z0-9_-]{40,}['"]""",
    r"""['"][A-Z0-9]{8}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{4}-[A-Z0-9]{12}['"]""",
)
IDEMPOTENCY_NAMES = ("idempotencyKey", "idempotency_key")

#: Taint sources by category (the first that matches names it), sinks, and names that clean a value.
TAINT_SOURCES = (
    ("request.body", "user_input"), ("request.query", "user_input"), ("request.params", "user_input"),
    ("req.body", "user_input"), ("req.query", "user_input"), ("req.params", "user_input"),
    ("ctx.request.body", "user_input"), ("event.body", "user_input"), ("process.env", "user_input"),
    ("response.data", "api_response"), ("res.data", "api_response"), ("axios.", "api_response"),
    ("fs.readFileSync", "file_read"), ("fs.readFile", "file_read"), ("readFile", "file_read"),
    ("process.env", "environment"),
)
TAINT_SINKS = (
    (("query", "execute", "raw", "$queryRaw", "$executeRaw"), "sql_injection", "critical"),
    (("exec", "execSync", "spawn", "spawnSync"), "command_injection", "critical"),
    (("innerHTML", "outerHTML", "document.write", "dangerouslySetInnerHTML"), "xss", "high"),
    (("readFile", "readFileSync", "writeFile", "writeFileSync"), "path_traversal", "high"),
)
SANITIZERS = (
    "escape", "escapeHtml", "sanitize", "sanitizeHtml", "encodeURIComponent", "encodeURI", "htmlEscape", "sqlEscape",
    "parameterize", "DOMPurify.sanitize", "validator.escape",
)


def has_secret(code: Column) -> Column:
    out = F.lit(False)
    for p in SECRETS:
        out = out | code.rlike(p)
    return out


def taint_category(expression: Column) -> Column:
    """The category of the first source whose text the expression has; null without."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, category in TAINT_SOURCES:
        out = out.when(expression.contains(pattern), category)
    return out


def sanitizers_in(argument: Column) -> Column:
    """Names of sanitisers that the argument has."""
    return F.array_compact(F.array(*[F.when(argument.contains(s), F.lit(s)) for s in SANITIZERS]))
