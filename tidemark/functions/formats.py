"""Formats of personal data and credentials: patterns as fixed values, checks and filters as column expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions import codes, scalars
from tidemark.functions import text as T


@dataclass(frozen=True)
class Format:
    """A kind of value: its pattern, a cheap pattern that every text with a match also meets, and how sure a match is.

    ``group`` is the part of the match that is the value.  With ``words``, the group ``name`` must have one of them.  With ``marks``, a match lies in
    one line, and only lines with one of these characters are searched.  Other matches lie in one line with what they need, unless the format
    ``crosses`` lines.  ``shape`` is in every text with a match, once its ASCII digits are 0 and its ASCII capitals are A.
    """

    kind: str
    subtype: str
    confidence: str
    need: str
    pattern: str
    group: int | str = 0
    words: tuple[str, ...] = ()
    flags: int = 0
    marks: str = ""
    crosses: bool = False
    shape: str = ""


# The patterns of the formats, in Python's syntax; "need" means the same in Java's.
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_DATE = (
    r"(?:(?:19|20)\d{2}[/.\-](?:0?[1-9]|1[0-2])[/.\-](?:0?[1-9]|[12]\d|3[01])"
    r"|(?:0?[1-9]|[12]\d|3[01])[/.\-](?:0?[1-9]|[12]\d|3[01])[/.\-](?:19|20)\d{2})"
)
_ASSIGNED = r"""(?<![\w.\-])(?P<name>[A-Za-z_][\w.\-]{0,63})["']?[ \t]*(?::=|=>|:|=)[ \t]*["']?"""
_QUOTE = r"""[\s"'=:]{1,6}"""

PERSONAL = (
    Format("pii", "aadhaar_number", "high", r"[2-9][0-9]{3}[ \-]?[0-9]{4}", r"(?<![\w.+\-])(?<!\d[ \-])[2-9]\d{3}[ \-]?\d{4}[ \-]?\d{4}(?!\w|[ \-]\d|\.\d)", shape="0000"),
    Format("pii", "pan_number", "high", r"[0-9]{4}[A-Z]", r"(?<![A-Za-z0-9])[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z](?![A-Za-z0-9])", shape="0000A"),
    Format("pii", "ifsc_code", "medium", r"[A-Z]{4}0[A-Z0-9]{6}", r"(?<![A-Za-z0-9])[A-Z]{4}0[A-Z0-9]{6}(?![A-Za-z0-9])", shape="AAAA"),
    Format("pii", "upi_id", "medium", r"@", r"(?<![\w.%+\-])[A-Za-z0-9._\-]{2,64}@(?!localhost\b)[A-Za-z][A-Za-z0-9]{1,31}(?![\w\-]|\.\w)"),
    Format("pii", "indian_mobile", "medium", r"[6-9][0-9]{4}", r"(?<![\w+.\-])(?:\+91[ \-]?|0)?(?:[6-9]\d{9}|[6-9]\d{4}[ \-]\d{5})(?!\w|\.\d)", shape="00000"),
    Format("pii", "gstin", "high", r"[0-9]{4}[A-Z][1-9A-Z]Z", r"(?<![A-Za-z0-9])(?:0[1-9]|[12]\d|3[0-8]|9[79])[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z](?![A-Za-z0-9])", shape="0000A"),
    Format("pii", "email", "high", r"@", r"(?<![\w.%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}|localhost)(?![\w\-])"),
    Format("pii", "phone_intl", "medium", r"\+[1-9]", r"(?<![\w+])\+[1-9](?:[ \-]?\d){6,14}(?!\w|[ \-]\d)", shape="+0"),
    Format("pii", "credit_card", "high", r"[0-9](?:[ \-]?[0-9]){12}", r"(?<![\w.\-])(?<!\d[ \-])\d(?:[ \-]?\d){12,18}(?!\w|[ \-]\d|\.\d)", shape="0"),
    Format("pii", "iban", "high", r"[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", shape="AA00"),
    Format("pii", "ipv4", "medium", r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]", rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)", shape="0.0"),
    Format("pii", "ipv6", "medium", r":[0-9A-Fa-f]{0,4}:", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])", shape=":"),
    Format("pii", "mac_address", "medium", r"[:\-][0-9A-Fa-f]{2}[:\-]", r"(?<![\w:\-])[0-9A-Fa-f]{2}([:\-])(?:[0-9A-Fa-f]{2}\1){4}[0-9A-Fa-f]{2}(?![\w:\-])"),
    Format("pii", "date_of_birth", "medium", r"(?i)dob|birth", _ASSIGNED + rf"(?P<value>{_DATE})(?!\w)", "value", ("dob", "birth", "birthday", "birthdate")),
    Format("pii", "passport_number", "low", r"(?i)passport", _ASSIGNED + r"(?P<value>(?=[A-Z0-9]*\d)[A-Z0-9]{6,9})(?![A-Za-z0-9])", "value", ("passport",)),
)

CREDENTIALS = (
    Format("secret", "aws_access_key", "high", r"A(?:KIA|SIA|GPA|IDA|ROA|IPA|NPA|NVA)", r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[0-9A-Z]{16}(?![A-Za-z0-9])", shape="AAAA"),
    Format("secret", "aws_secret_key", "medium", r"(?i)aws", r"aws[\w.\-]{0,24}?secret[\w.\-]{0,24}?" + _QUOTE + r"([A-Za-z0-9/+=]{40})(?![A-Za-z0-9/+=])", 1, flags=re.IGNORECASE, crosses=True),
    Format("secret", "gcp_service_account_key", "high", r"service_account", r'\{[^{}]{0,8000}"type"\s*:\s*"service_account"[^{}]{0,8000}\}', crosses=True),
    Format("secret", "gcp_api_key", "high", r"AIza", r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_\-]{35}(?![0-9A-Za-z_\-])"),
    Format("secret", "azure_storage_connection_string", "high", r"AccountKey", r"DefaultEndpointsProtocol=https?;AccountName=[a-z0-9]{3,24};AccountKey=[A-Za-z0-9+/]{86}=="),
    Format("secret", "azure_client_secret", "medium", r"Q~", r"(?<![A-Za-z0-9_.~\-])[A-Za-z0-9_.\-]{3}\dQ~[A-Za-z0-9_.~\-]{31,34}(?![A-Za-z0-9_.~\-])"),
    Format("secret", "github_token", "high", r"gh[pousr]_", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])", shape="gh"),
    Format("secret", "github_token", "high", r"github_pat_", r"(?<![A-Za-z0-9])github_pat_[A-Za-z0-9_]{82}(?![A-Za-z0-9_])"),
    Format("secret", "slack_token", "high", r"xox[abprs]-", r"(?<![A-Za-z0-9])xox[abprs]-(?:[0-9]{8,15}-){1,3}[A-Za-z0-9]{20,40}(?![A-Za-z0-9])", shape="xox"),
    Format("secret", "slack_token", "high", r"xapp-", r"(?<![A-Za-z0-9])xapp-[0-9]-[A-Z0-9]{9,12}-[0-9]{12,16}-[a-f0-9]{60,70}(?![A-Za-z0-9])"),
    Format("secret", "slack_webhook", "high", r"hooks\.slack\.com", r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,12}/B[A-Z0-9]{8,12}/[A-Za-z0-9]{24}", shape="hooks.slack.com"),
    Format("secret", "stripe_secret_key", "high", r"sk_(?:live|test)_", r"(?<![A-Za-z0-9])sk_(?:live|test)_[A-Za-z0-9]{24,99}(?![A-Za-z0-9])", shape="sk_"),
    Format("secret", "stripe_restricted_key", "high", r"rk_(?:live|test)_", r"(?<![A-Za-z0-9])rk_(?:live|test)_[A-Za-z0-9]{24,99}(?![A-Za-z0-9])", shape="rk_"),
    Format("secret", "razorpay_key_id", "high", r"rzp_(?:live|test)_", r"(?<![A-Za-z0-9])rzp_(?:live|test)_[A-Za-z0-9]{14}(?![A-Za-z0-9])", shape="rzp_"),
    Format("secret", "razorpay_key_secret", "medium", r"(?i)razorpay", r"razorpay[\w.\-]{0,24}?secret[\w.\-]{0,24}?" + _QUOTE + r"([A-Za-z0-9]{24})(?![A-Za-z0-9])", 1, flags=re.IGNORECASE, crosses=True),
    Format("secret", "paytm_merchant_key", "medium", r"(?i)paytm", r"paytm[\w.\-]{0,24}?key[\w.\-]{0,12}?" + _QUOTE + r"([A-Za-z0-9@#$%&*!_+\-]{16})(?![A-Za-z0-9@#$%&*!_+\-])", 1, flags=re.IGNORECASE, crosses=True),
    Format("secret", "jwt", "high", r"eyJ", r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]*)?"),
    Format("secret", "private_key_block", "high", r"-----BEGIN", r"-----BEGIN ((?:RSA |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?)-----[\s\S]{0,16000}?-----END \1-----", crosses=True),
    Format("secret", "private_key_block", "medium", r"-----BEGIN", r"-----BEGIN (?:RSA |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY(?: BLOCK)?-----(?:\r?\n[A-Za-z0-9+/=:, \-]{16,100}){2,200}", crosses=True),
    Format("secret", "ssh_private_key", "high", r"-----BEGIN OPENSSH", r"-----BEGIN (OPENSSH PRIVATE KEY)-----[\s\S]{0,16000}?-----END \1-----", crosses=True),
    Format(
        "secret", "connection_string", "high", r"://",
        r"(?<![A-Za-z0-9+.\-])(?:jdbc:[a-z0-9]{2,12}:)?(?:postgres(?:ql)?|mysql|mariadb|mongodb(?:\+srv)?|rediss?|amqps?|mssql|sqlserver|oracle)"
        r"://[^\s:/@'\"`]{1,64}:[^\s@'\"`/]{1,128}@[^\s'\"`]{1,256}", flags=re.IGNORECASE,
    ),
    Format(
        "secret", "basic_auth_url", "high", r"(?i)https?://",
        r"(?<![A-Za-z0-9+.\-])https?://[^\s:/@'\"`]{1,64}:[^\s@'\"`/]{1,128}@[^\s'\"`/?#]{1,255}(?:[/?#][^\s'\"`]*)?", flags=re.IGNORECASE, shape="://",
    ),
    Format("secret", "npm_token", "high", r"npm_", r"(?<![A-Za-z0-9])npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    Format("secret", "pypi_token", "high", r"pypi-", r"(?<![A-Za-z0-9])pypi-AgEIcHlwaS5vcmc[A-Za-z0-9_\-]{50,}(?![A-Za-z0-9_\-])"),
    Format("secret", "docker_registry_auth", "medium", r'"auth"', r'"auth"\s*:\s*"([A-Za-z0-9+/]{16,}={0,2})"', 1, crosses=True),
    Format("secret", "docker_registry_auth", "high", r"dckr_pat_", r"(?<![A-Za-z0-9])dckr_pat_[A-Za-z0-9_\-]{27}(?![A-Za-z0-9_\-])"),
    Format("secret", "twilio_api_key", "high", r"SK[0-9a-f]", r"(?<![A-Za-z0-9])SK[0-9a-f]{32}(?![A-Za-z0-9])", shape="AA"),
    Format("secret", "sendgrid_api_key", "high", r"SG\.", r"(?<![A-Za-z0-9])SG\.[A-Za-z0-9_\-]{22}\.[A-Za-z0-9_\-]{43}(?![A-Za-z0-9_\-])", shape="AA."),
)

# Assigned calling codes, and lengths of account numbers by country.
CALLING_CODES = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CALLING_RANGES = (
    (211, 213), (216, 216), (218, 218), (220, 258), (260, 269), (290, 291), (297, 299), (350, 359), (370, 389), (420, 421), (423, 423), (500, 509),
    (590, 599), (670, 670), (672, 683), (685, 692), (850, 850), (852, 853), (855, 856), (880, 880), (886, 886), (960, 968), (970, 977), (992, 996), (998, 998),
)
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 "
    "GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 "
    "PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
TEST_CARDS = (
    "4111111111111111 4012888888881881 4222222222222 4242424242424242 4000056655665556 5555555555554444 5105105105105100 5200828282828210 "
    "2223003122003222 378282246310005 371449635398431 378734493671000 6011111111111117 6011000990139424 30569309025904 38520000023237 "
    "3530111333300000 3566002020360505 3056930009020004 36227206271667 6200000000000005"
)
EXAMPLE_FOLDERS = ("test", "tests", "__tests__", "spec", "specs", "fixtures", "fixture", "testdata", "example", "examples", "samples", "sample", "docs", "doc")
EXAMPLE_WORDS = ("example", "sample", "dummy", "fake", "not-a-real", "not_a_real")
LOCK_FILES = (
    "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "pipfile.lock", "cargo.lock", "go.sum", "composer.lock", "gemfile.lock", "uv.lock",
    "npm-shrinkwrap.json", "packages.lock.json", "manifest.json", "manifest.yaml", "manifest.yml",
)
HASH_FIELDS = ("integrity", "hash", "checksum", "sha", "sha1", "sha256", "sha512", "md5", "digest", "etag")
PLACEHOLDER_SHAPES = (r"(.)\1{3,}", r"[xX*#.\-_]{4,}", r"<[^<>]{1,40}>", r"\$\{[^}]{1,64}\}", r"\{\{[^}]{1,64}\}\}", r"%\([^)]{1,64}\)s", r"(?i)your[-_ ]?[\w-]{0,30}[-_ ]?here")
REPEATS = 20


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _only(value: Column, pattern: str) -> Column:
    """The value where it meets a pattern, else null: what follows then never sees another shape."""
    return F.when(value.rlike(pattern), value)


def _yes(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def identity_number_valid(value: Column) -> Column:
    """Twelve digits with Verhoeff's check digit, which are neither all the same nor count up or down."""
    digits = _only(digits_of(value), "^[2-9][0-9]{11}$")
    run = F.lit("0123456789" * 3).contains(digits) | F.lit("9876543210" * 3).contains(digits) | digits.rlike(r"^(.)\1+$")
    return _yes(scalars.verhoeff_valid(digits) & ~run)


def phone_valid(value: Column) -> Column:
    """A plus, 8 to 15 digits, and an assigned calling code."""
    three = [str(n) for low, high in CALLING_RANGES for n in range(low, high + 1)]
    code = "|".join(["1", "7", *CALLING_CODES.split(), *three])
    return value.startswith("+") & digits_of(value).rlike(f"^(?=[0-9]{{8,15}}$)(?:{code})")


def indian_mobile_valid(value: Column) -> Column:
    digits = digits_of(value)
    local = F.when(F.ltrim(value).startswith("+91"), F.substr(digits, F.lit(3))).otherwise(F.regexp_replace(digits, "^0", ""))
    return local.rlike("^[6-9][0-9]{9}$")


def card_valid(value: Column) -> Column:
    digits = _only(digits_of(value), "^[0-9]{13,19}$")
    return _yes(codes.card_network_fits(digits) & T.luhn_valid(digits))


def account_valid(value: Column) -> Column:
    """A known country's length, and the remainder by 97."""
    compact = F.replace(value, F.lit(" "), F.lit(""))
    lengths = F.create_map(*(F.lit(x) for e in IBAN_LENGTHS.split() for x in (e[:2], int(e[2:]))))
    return _yes((F.try_element_at(lengths, F.substring(compact, 1, 2)) == F.char_length(compact)) & scalars.iban_valid(compact))


def ipv6_valid(value: Column) -> Column:
    """Eight groups, or fewer around one double colon; three hexadecimal digits at least."""
    whole = value.rlike("^(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$")
    side = "(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4})*)?"
    groups = F.size(F.filter(F.split(value, ":"), lambda x: x != ""))
    return (whole | (value.rlike(f"^{side}::{side}$") & (groups <= 7))) & (F.char_length(F.replace(value, F.lit(":"), F.lit(""))) >= 3)


def _decoded(value: Column) -> Column:
    """The text of a base64 value of either alphabet, padded here; null if it isn't one."""
    plain = F.translate(value, "-_", "+/")
    padded = F.concat(plain, F.repeat(F.lit("="), F.pmod(-F.char_length(plain), F.lit(4))))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def token_valid(value: Column) -> Column:
    """Three segments, of which the first decodes to JSON with an algorithm."""
    parts = F.split(value, r"\.", -1)
    header, body = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    return _yes((F.size(parts) == 3) & F.get_json_object(_decoded(header), "$.alg").isNotNull() & _decoded(body).isNotNull())


def accepted(subtype: Column, value: Column) -> Column:
    """Whether a value passes the check of its format; formats without a check pass."""
    auth = _decoded(value)
    return (
        F.when(subtype == "aadhaar_number", identity_number_valid(value))
        .when(subtype == "indian_mobile", indian_mobile_valid(value))
        .when(subtype == "gstin", codes.gstin_valid(value))
        .when(subtype == "phone_intl", phone_valid(value))
        .when(subtype == "credit_card", card_valid(value))
        .when(subtype == "iban", account_valid(value))
        .when(subtype == "ipv6", ipv6_valid(value))
        .when(subtype == "date_of_birth", codes.birth_date_valid(_only(value, r"^[0-9]+([/.\-][0-9]+){2}$")))
        .when(subtype == "jwt", token_valid(value))
        .when(subtype.isin("private_key_block", "ssh_private_key"), value.rlike(r"^-----BEGIN [A-Z ]*-----(?!\s*-----END)"))
        .when(subtype.isin("connection_string", "basic_auth_url"), value.rlike(r"(?i)^[a-z0-9+.\-]+://[^/?#:]*:[^/?#]+@"))
        .when(subtype == "gcp_service_account_key", F.get_json_object(value, "$.private_key").isNotNull() & F.get_json_object(value, "$.client_email").isNotNull())
        .when(subtype == "docker_registry_auth", value.startswith("dckr_pat_") | _yes(auth.rlike(r"(?s)^[^:]+:.+") & F.is_valid_utf8(auth)))
        .otherwise(F.lit(True))
    )


def placeholder_shape(value: Column) -> Column:
    """Whether a value looks like one that stands for another."""
    shape = "|".join(f"^(?:{p})$" for p in PLACEHOLDER_SHAPES[1:])
    return value.rlike(f"^(?:{PLACEHOLDER_SHAPES[0]})$") | value.rlike(shape)


def in_example_folder(path: Column) -> Column:
    """Whether a folder of the path, or the file itself, is one of tests, examples or documents."""
    parts = F.split(F.lower(F.translate(path, "\\", "/")), "/")
    return _yes(F.arrays_overlap(parts, F.array(*map(F.lit, EXAMPLE_FOLDERS))))


def personal_filter(subtype: Column, value: Column, before: Column, path: Column) -> Column:
    """The name of the first rule that tells a value from personal data, or null; card_test_number only lowers confidence."""
    digits = digits_of(value)
    minute = lambda text: F.year(F.try_to_timestamp(_only(text, "^[0-9]{12}$"), F.lit("yyyyMMddHHmm"))).between(1970, 2100)
    stamp = _yes(digits.rlike("^[0-9]{12}$") & (_yes(minute(digits)) | _yes(minute(F.concat(F.lit("20"), F.substring(digits, 1, 10))))))
    version = before.rlike(r"""(?i)(?:version|ver|build|release|rev|revision)[\s:=_"'.\-]*$""")
    periodic = digits.rlike(r"^(?=[0-9]{2})([0-9]*)([0-9]*)(?<=[0-9])(?:\1\2)+\1$")
    four = value.rlike(r"^(?:0\.0\.0\.0|127\.0\.0\.1|192\.0\.2\.[0-9]+|198\.51\.100\.[0-9]+|203\.0\.113\.[0-9]+)$")
    six = value.rlike(r"(?i)^(?:[0:]+|[0:]*:0{0,3}1|2001:0?db8:.*)$")
    domain = F.lower(F.regexp_extract(value, "@([^@]*)$", 1))
    return (
        F.when((subtype == "aadhaar_number") & stamp, "timestamp_like")
        .when((subtype == "aadhaar_number") & version, "version_like")
        .when(subtype.isin("aadhaar_number", "indian_mobile") & in_example_folder(path) & periodic, "fixture_sequence")
        .when(((subtype == "ipv4") & four) | ((subtype == "ipv6") & six), "reserved_address")
        .when((subtype == "email") & domain.isin("example.com", "example.org", "localhost"), "example_email_domain")
        .when((subtype == "credit_card") & digits.isin(*TEST_CARDS.split()), "card_test_number")
    )


def secret_filter(value: Column, path: Column, line: Column, field: Column, occurrences: Column, placeholders: tuple[str, ...] = ()) -> Column:
    """The name of the first rule that tells a value from a secret, or null; repeated_value only lowers confidence."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    digest = value.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|[0-9a-fA-F]{128})$") | value.rlike("^(?:sha1|sha256|sha384|sha512|md5)-[A-Za-z0-9+/]{20,}={0,2}$")
    listed = name.isin(*LOCK_FILES) | name.endswith(".lock") | _yes(F.lower(field).isin(*HASH_FIELDS))
    text = _decoded(_only(F.regexp_replace(value, "=+$", ""), "^[A-Za-z0-9+/]{14,}$"))
    shown = _only(text, r"^[\x20-\x7e]+$")
    letters = F.char_length(F.regexp_replace(shown, "[^A-Za-z ]", ""))
    words = (F.char_length(value) >= 16) & value.rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.regexp_count(shown, F.lit("[A-Za-z]{3,}")) >= 2) & (letters / F.char_length(shown) >= 0.85)
    placeholder = placeholder_shape(value) | F.lower(value).isin(*placeholders)
    folders = F.split(F.lower(F.regexp_replace(path, "/?[^/]*$", "")), "/")
    near = F.lower(F.concat_ws(" ", value, line))
    example = F.arrays_overlap(folders, F.array(*map(F.lit, EXAMPLE_FOLDERS))) & near.rlike("|".join(EXAMPLE_WORDS))
    return (
        F.when(digest & listed, "hash_in_manifest")
        .when(value.rlike("^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), "uuid")
        .when(_yes(words), "base64_text")
        .when(placeholder, "placeholder_value")
        .when(_yes(example), "example_marker")
        .when(occurrences > REPEATS, "repeated_value")
    )
