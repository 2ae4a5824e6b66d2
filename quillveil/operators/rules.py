"""The ordered rule table. The order is the tie-breaker between matches of equal length.

Patterns are run by Java's engine with ``(?dU)``: only \\n ends a line, and character classes are
Unicode's. ``gate`` is an expression implied by the pattern that most texts fail cheaply.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import validators as v

Check = Callable[[Column, Column, Column, Column], Column]  # value, text, start, end


@dataclass(frozen=True)
class Rule:
    entity_type: str
    pattern: str
    group: int = 0
    check: Check | None = None
    gate: tuple[str, ...] = ()  # any of these occurs in the lower-cased text
    shape: str = ""  # and the text matches this cheap pattern
    any_case: bool = False
    quoted: bool = False  # the match may end with a quote that is not part of the value

    @property
    def java(self) -> str:
        return ("(?dUi)" if self.any_case else "(?dU)") + self.pattern


@lru_cache(maxsize=None)
def _value(f: Callable[[Column], Column]) -> Check:
    """A check of the value alone; one object for one function, so that rules can share it."""
    return lambda value, text, start, end: f(value)


@lru_cache(maxsize=None)
def _near(words: tuple[str, ...], f: Callable[[Column], Column] | None = None) -> Check:
    return lambda value, text, start, end: (f(value) & v.near(text, start, end, words)) if f else v.near(text, start, end, words)


# What may end a value that has no delimiter, and the shapes shared by several rules.
LABELS = (
    r"(?:full\s+legal\s+name|date\s+of\s+birth|ssn|passport\s+no\.?|"
    r"driver(?:'s)?\s+licen[cs]e|issuing\s+state|mother's\s+maiden\s+name|"
    r"(?:employee|payroll)\s+id|home\s+address|(?:personal\s+|work\s+)?email|mobile\s+phone|"
    r"emergency\s+contact|ip\s+address|device\s+id|bank|account\s+holder|"
    r"routing\s+number|account\s+number|credit\s+card|expiration\s*/\s*cvv|"
    r"annual\s+income|tax\s+filing\s+status|employer|manager|"
    r"work\s+phone|office\s+address|username|temporary\s+password|password|"
    r"api\s+(?:token|key)|security\s+answer|health\s+plan|member\s+id|"
    r"group\s+number|primary\s+physician|medical\s+record\s+(?:number|no\.?)|"
    r"blood\s+type|condition|medication|recent\s+visit|clinic|"
    r"verification\s+pin|\d+\.\s+[A-Za-z])"
)
FIELD_END = rf"(?=\s+(?i:{LABELS})|[\r\n]+)"
TEXT_END = rf"(?=\s+(?i:{LABELS})|[\r\n]+|$)"
FREE = r"(\S(?:.{0,98}?\S)?)"
DATE = (
    r"((?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|"
    r"Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|"
    r"Dec(?:ember)?)\s+\d{1,2},?\s+\d{4}|\d{1,2}[/-]\d{1,2}[/-]\d{2,4})"
)
PEM = r"(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"

# The rules in order. A label rule's value is the tail of its match.
RULES: tuple[Rule, ...] = (
    Rule("SSN", r"\b\d{3}-\d{2}-\d{4}\b", check=_value(v.ssn), shape=r"(?U)\d-\d\d-\d"),
    Rule("SSN", r"\b\d{9}\b", check=_near(v.SSN_WORDS, v.ssn), gate=v.SSN_WORDS),
    Rule("ITIN", r"\b(9\d{2})-(\d{2})-(\d{4})\b", check=_value(v.itin), shape=r"(?U)\d-\d\d-\d"),
    Rule("EIN", r"\b(\d{2})-(\d{7})\b", check=_value(v.ein_prefix), shape=r"(?U)\d-\d{7}"),
    Rule("EIN", r"\b\d{9}\b", check=_near(v.EIN_WORDS, v.ein_prefix), shape=r"(?U)\d{9}"),
    Rule("CREDIT_CARD", r"\b\d(?:[ -]?\d){12,18}\b", check=_value(v.card), shape=r"(?U)\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"),
    Rule("ROUTING_NUMBER", r"\b\d{9}\b", check=_near(v.ROUTING_WORDS, v.aba), shape=r"(?U)\d{9}"),
    Rule("BANK_ACCOUNT", r"\b\d{6,17}\b", check=_near(v.ACCOUNT_WORDS), gate=v.ACCOUNT_WORDS),
    Rule(
        "PHONE",
        r"(?<!\d)(?:\+?1[\s.-]?)?\(?[2-9]\d{2}\)?[\s.-]?[2-9]\d{2}[\s.-]?\d{4}(?:\s*(?:ext\.?|x)\s*\d{1,10})?(?!\d)",
        check=_value(v.nanp),
        any_case=True,
        shape=r"(?U)\d{3}[\s.-]?\d{4}",
    ),
    Rule("PHONE", r"(?<!\d)\+\d{1,3}[\s.-]?\d{1,4}(?:[\s.-]?\d{2,4}){1,4}(?!\d)", check=_value(v.international), gate=("+",)),
    Rule(
        "EMAIL",
        r"\b[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+\b",
        check=_value(v.email),
        gate=("@",),
    ),
    Rule("URL", r"\bhttps?://[^\s<>\"')\]]+", gate=("://",)),
    Rule("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", check=_value(v.ipv4), shape=r"(?U)\d\.\d"),
    Rule("IP_ADDRESS", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Fa-f:])", check=_value(v.ipv6), gate=(":",), shape=r":[0-9A-Fa-f]{0,4}:"),
    Rule("MAC_ADDRESS", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", gate=(":", "-"), shape=r"[:-][0-9A-Fa-f]{2}[:-]"),
    Rule("API_KEY", r"\bAKIA[0-9A-Z]{16}\b", gate=("akia",)),
    Rule("API_KEY", r"\bgh[pos]_[A-Za-z0-9]{36,}\b", gate=("ghp_", "gho_", "ghs_")),
    Rule("API_KEY", r"\bsk_live_[A-Za-z0-9]{16,}\b", gate=("sk_live_",)),
    Rule("API_KEY", r"\bsk_(?:live|test)_[A-Za-z0-9]{16,}\b", gate=("sk_live_", "sk_test_")),
    Rule(
        "API_KEY",
        r"\b(?:api[_-]?key|secret[_-]?key|access[_-]?token|auth[_-]?token|secret|token|password|passwd|pwd)\b"
        r"\s*[:=]\s*[\"']?([A-Za-z0-9_\-/+]{20,100})[\"']?",
        group=1,
        check=_value(lambda x: v.secret(x, 20)),
        any_case=True,
        quoted=True,
        gate=("key", "token", "secret", "passw", "pwd"),
    ),
    Rule("DATE_OF_BIRTH", rf"\b(?:date\s+of\s+birth|dob)\b\s*[:=]?\s*{DATE}", group=1, any_case=True, gate=("birth", "dob")),
    Rule("DRIVERS_LICENSE", r"\b(?:driver(?:'s)?\s+licen[cs]e|dl\s*(?:number|no\.?))\b\s*[:=]?\s*([A-Z0-9][A-Z0-9-]{4,24})", group=1, any_case=True, gate=("driver", "dl"), shape=r"(?Ui)\bdriver|\bdl\s*n"),
    Rule(
        "DEVICE_ID",
        r"\bdevice\s+id\b\s*[:=]?\s*([0-9A-F]{8}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F](?:\s?[0-9A-F]){11})",
        group=1,
        any_case=True,
        gate=("device",),
    ),
    Rule("GOVERNMENT_ID", r"\b(?:employee|payroll)\s+id\b\s*[:=]?\s*([A-Z0-9][A-Z0-9-]{3,24})", group=1, check=_value(v.labelled_id), any_case=True, gate=("employee", "payroll")),
    Rule("GOVERNMENT_ID", r"\bverification\s+pin\b\s*[:=]?\s*(\d{4,12})", group=1, any_case=True, gate=("verification",)),
    Rule(
        "MEDICAL_ID",
        r"\b(?:member\s+id|group\s+number|medical\s+record\s+(?:number|no\.?))\s*[:=]?\s*([A-Z0-9][A-Z0-9-]{3,24})",
        group=1,
        check=_value(v.labelled_id),
        any_case=True,
        gate=("member", "group", "medical"),
    ),
    Rule("CREDENTIAL", r"\busername\b\s*[:=]\s*([^\s,;]{6,100})", group=1, check=_value(v.credential), any_case=True, gate=("username",)),
    Rule("CREDENTIAL", rf"\busername\b\s+([^\s,;]{{6,100}}){FIELD_END}", group=1, check=_value(v.credential), any_case=True, gate=("username",)),
    Rule("CREDENTIAL", r"\b(?:temporary\s+password|password)\b\s*[:=]\s*[\"']([^\"'\r\n]{6,100})[\"']", group=1, any_case=True, quoted=True, gate=("password",)),
    Rule(
        "CREDENTIAL",
        rf"\b(?:temporary\s+password|password)\b\s*[:=]\s*(?![\"']){FREE}{TEXT_END}",
        group=1,
        check=_value(v.password),
        any_case=True,
        gate=("password",),
    ),
    Rule("CREDENTIAL", rf"\btemporary\s+password\b\s+{FREE}{TEXT_END}", group=1, check=_value(v.password), any_case=True, gate=("temporary",)),
    Rule("CREDENTIAL", rf"\bPassword\b\s+{FREE}{FIELD_END}", group=1, check=_value(v.password), gate=("password",)),
    Rule("CREDENTIAL", rf"\bsecurity\s+answer\b\s*[:=]\s*{FREE}{TEXT_END}", group=1, check=_value(v.credential), any_case=True, gate=("security",)),
    Rule("CREDENTIAL", rf"\bsecurity\s+answer\b\s+{FREE}{FIELD_END}", group=1, check=_value(v.credential), any_case=True, gate=("security",)),
    Rule("API_KEY", r"\b(?:api\s+token|api\s+key)\b\s*[:=]?\s*([^\s,;]{16,100})", group=1, check=_value(lambda x: v.secret(x, 16)), any_case=True, gate=("api",)),
    Rule("FINANCIAL_INFORMATION", r"\b(?:expiration\s*/\s*cvv|cvv)\b\s*[:=]?\s*(\d{1,2}/\d{2,4}\s*/\s*\d{3,4}|\d{3,4})", group=1, any_case=True, gate=("cvv",)),
    Rule("FINANCIAL_INFORMATION", r"\bannual\s+income\b\s*[:=]?\s*(\$[\d,]+(?:\.\d{2})?)", group=1, any_case=True, gate=("annual",)),
    Rule(
        "FINANCIAL_INFORMATION",
        r"\btax\s+filing\s+status\b\s*[:=]?\s*(single|married\s+filing\s+(?:jointly|separately)|head\s+of\s+household|widow(?:er)?)",
        group=1,
        any_case=True,
        gate=("filing",),
    ),
    Rule(
        "STREET_NAME",
        r"\b(\d{1,6}\s+(?:(?!(?:address|phone|ext|number|id)\b)[A-Z0-9.'-]+\s+){0,5}"
        r"(?:Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Lane|Ln\.?|"
        r"Drive|Court|Ct\.?|Terrace|Way|Place|Pl\.?)(?![A-Za-z])"
        r"(?:,?\s+(?:Apt\.?|Suite|Ste\.?|Unit|#)\s*[A-Z0-9-]+)?)",
        group=1,
        any_case=True,
        shape=r"(?U)\d\s",
    ),
    Rule("HEALTH_INFORMATION", r"\bblood\s+type\b\s*[:=]?\s*((?:A|B|AB|O)\s+(?:positive|negative))", group=1, any_case=True, gate=("blood",)),
    Rule("HEALTH_INFORMATION", rf"\bhealth\s+plan\b\s*[:=]\s*{FREE}{TEXT_END}", group=1, any_case=True, gate=("health",)),
    Rule("HEALTH_INFORMATION", rf"\bhealth\s+plan\b\s+{FREE}{FIELD_END}", group=1, any_case=True, gate=("health",)),
    Rule("HEALTH_INFORMATION", rf"\bprimary\s+physician\b\s*[:=]\s*{FREE}{TEXT_END}", group=1, any_case=True, gate=("physician",)),
    Rule("HEALTH_INFORMATION", rf"\bprimary\s+physician\b\s+{FREE}{FIELD_END}", group=1, any_case=True, gate=("physician",)),
    Rule("HEALTH_INFORMATION", rf"\brecent\s+visit\b\s*[:=]?\s*{DATE}", group=1, any_case=True, gate=("recent",)),
    Rule("HEALTH_INFORMATION", rf"\b(?:clinic|condition|medication)\b\s*[:=]\s*{FREE}{TEXT_END}", group=1, any_case=True, gate=("clinic", "condition", "medication")),
    Rule("HEALTH_INFORMATION", rf"\b(?:Clinic|Condition|Medication)\b\s+{FREE}{FIELD_END}", group=1, gate=("clinic", "condition", "medication")),
    Rule("PRIVATE_KEY", rf"-----BEGIN {PEM}[\s\S]+?-----END {PEM}", gate=("private key",)),
    Rule("JWT", r"\b(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\b", check=_value(v.jwt), gate=("eyj",)),
)


def gate_of(rule: Rule, text: Column, lower: Column, digit: Column) -> Column | None:
    """What a text must show before the rule runs; ``digit`` says once whether it has any digit."""
    out = None
    for word in rule.gate:
        hit = lower.contains(word)
        out = hit if out is None else out | hit
    if rule.shape:
        first = digit if rule.shape.startswith(r"(?U)\d") else out
        out = text.rlike(rule.shape) if first is None else first & text.rlike(rule.shape)
    return out


def literal_rule(keyword: str) -> Rule:
    """A whole-word, any-case rule for a user's keyword.

    The literal comes first, so that the engine looks at word borders only where it stands; folding is character by
    character, so what is before it lies its length behind. Plain keywords are gated: besides k and the Kelvin sign,
    which lower-casing joins, only long s and dotless i fold onto ASCII letters (``folded`` undoes them).
    """
    literal = keyword.replace(chr(92) + "E", chr(92) + "E" + chr(92) * 2 + "E" + chr(92) + "Q")
    gate = (keyword.lower(),) if keyword.isascii() else ()
    return Rule("CUSTOM", rf"\Q{literal}\E(?<!\w[\s\S]{{{len(keyword)}}})(?!\w)", any_case=True, gate=gate)


def folded(lower: Column) -> Column:
    """Lower-cased text with the characters that any-case matching takes for s and i."""
    return F.translate(lower, "ſı", "si")
