"""Secrets without a documented shape: values assigned to credential names, and tokens of high entropy for their alphabet.

Python only finds where candidates stand; names, alphabets, thresholds and filters are columns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import codes, formats
from tidemark.functions import text as T
from tidemark.functions.formats import Format
from tidemark.operators.detection import spans
from tidemark.operators.filters import filtered, listed
from tidemark.operators.graph import stored

# Words and pairs of words of credential names, last words of names that only speak of one, files whose values
# need no quotes, words that are no strings, how references begin, and the shapes of references.
CREDENTIAL_WORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "credential", "auth")
CREDENTIAL_PAIRS = ("api key", "access key", "private key", "session key", "signing key")
OTHER_HEADS = (
    "hint prompt label placeholder text message msg name length policy type url uri path file field regex pattern header endpoint expiry expires ttl id"
)
CONFIG_FILES = r"(?i)(?:^|/)(?:\.env[^/]*|[^/]*\.(?:env|ini|cfg|conf|properties|toml|ya?ml))$"
NO_STRINGS = ("true", "false", "null", "none", "nil", "undefined", "yes", "no", "on", "off")
REFERENCE_STARTS = r"^[$%<!&*|>@{\[(]"
REFERENCES = r"^(?:\$\{[^}]*\}|\$[A-Za-z_]\w*|\{\{[^}]*\}\}|%\([^)]*\)s|\$\([^)]*\))$"
LEAST_VALUE, MEDIUM_VALUE = 4, 12
# Alphabets from the narrowest on, with the length and the bits a character that make a secret.
ALPHABETS = (
    ("hex", "[0-9a-fA-F]+", 32, 3.2),
    ("base58", "[1-9A-HJ-NP-Za-km-z]+", 25, 4.2),
    ("alphanumeric", "[A-Za-z0-9]+", 16, 3.8),
    ("base64url", r"[A-Za-z0-9_\-]+", 20, 4.5),
    ("base64", "[A-Za-z0-9+/]+={0,2}", 20, 4.5),
)

_WORDS = "(?i)" + "|".join([*CREDENTIAL_WORDS, "key"])
_SIGN = r"""[ \t]*(?::=|=>|=(?!=)|:(?!:))[ \t]*"""
_NAME = r"""(?P<name>["']?[A-Za-z_][\w.\-]{0,63}["']?)"""
_TOKEN = r"[A-Za-z0-9+/=_\-]{16,512}"
ASSIGNMENTS = (
    Format("secret", "generic_credential", "quoted", _WORDS, rf"""(?<![\w.\-]){_NAME}{_SIGN}(["'])(?P<value>(?:(?!\2)[^\\\r\n]|\\.){{4,512}})\2""", "value", flags=re.ASCII, marks=":="),
    Format("secret", "generic_credential", "bare", _WORDS, rf"""(?m)^[ \t-]*(?:export[ \t]+)?{_NAME}{_SIGN}(?P<value>[^\s"'#,;]{{4,512}})[ \t]*\r?$""", "value", flags=re.ASCII, marks=":="),
)
TOKENS = (
    Format("secret", "high_entropy_string", "quoted", r"[A-Za-z0-9+/=_\-]{16}", rf"""(["'`])(?P<value>{_TOKEN})\1""", "value", flags=re.ASCII, marks="\"'`"),
    Format("secret", "high_entropy_string", "line", r"[A-Za-z0-9+/=_\-]{16}", rf"""(?m)^[ \t]*(?:export[ \t]+)?(?P<name>[\w.\-"']{{1,64}})[ \t]*[:=][ \t]*(?P<value>{_TOKEN})[ \t]*\r?$""", "value", flags=re.ASCII, marks=":="),
)


def names_credential(name: Column) -> Column:
    """Whether a name has a credential's word, or two in a row that make one, and doesn't end in a word that only speaks of it."""
    words = F.transform(codes.sub_words(F.regexp_replace(name, "^[\"']+|[\"']+$", "")), F.lower)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, 2), " "))
    has = F.arrays_overlap(words, F.array(*map(F.lit, CREDENTIAL_WORDS))) | F.arrays_overlap(pairs, F.array(*map(F.lit, CREDENTIAL_PAIRS)))
    return (F.size(words) > 0) & ~F.element_at(words, -1).isin(*OTHER_HEADS.split()) & has


def alphabet(value: Column) -> Column:
    """(name, threshold) of the narrowest alphabet whose length the value has; null if there is none."""
    found = F.lit(None)
    for name, pattern, least, bits in reversed(ALPHABETS):
        fits = value.rlike(f"^{pattern}$") & (F.char_length(value) >= least)
        found = F.when(fits, F.struct(F.lit(name).alias("name"), F.lit(bits).alias("threshold"))).otherwise(found)
    return found


def _usable(value: Column) -> Column:
    return (F.char_length(value) >= LEAST_VALUE) & ~F.lower(value).isin(*NO_STRINGS) & ~value.rlike(REFERENCES)


def assigned(docs: DataFrame, ident: str, text: str, path: str | None = None, placeholders: DataFrame | None = None) -> DataFrame:
    """Values assigned to credential names: quoted ones anywhere, bare ones in files of settings, with ``first_byte``, where the value first stands in its text.

    Long ones that are no placeholders are of medium confidence.
    """
    found = spans(docs, ident, text, ASSIGNMENTS, path, first=True)
    bare = F.col("confidence") == "bare"
    settings = F.col("path").rlike(CONFIG_FILES) & ~F.col("value").rlike(REFERENCE_STARTS)
    kept = listed(found.where(names_credential(F.col("name")) & _usable(F.col("value")) & (~bare | settings)), placeholders)
    sure = (F.char_length("value") >= MEDIUM_VALUE) & ~formats.placeholder_shape(F.col("value")) & ~F.col("listed")
    return kept.withColumns({"confidence": F.when(sure, "medium").otherwise("low"), "downgraded": F.lit(False)}).drop("listed")


def entropic(docs: DataFrame, ident: str, text: str, path: str | None = None, placeholders: DataFrame | None = None) -> DataFrame:
    """Quoted tokens and values of lines whose entropy is that of a secret in their alphabet, without those that the filters drop; with ``alphabet`` and ``bits``."""
    found = spans(docs, ident, text, TOKENS, path).dropDuplicates(["ident", "start_byte", "end_byte", "value"])
    kind = alphabet(F.col("value"))
    rows = found.withColumn("kind_of", kind).where("kind_of IS NOT NULL").withColumn("bits", T.shannon_entropy(F.col("value"))).where("bits >= kind_of.threshold")
    named = rows.withColumn("alphabet", F.col("kind_of.name")).withColumn("confidence", F.lit("low")).drop("kind_of")
    return filtered(stored(named), placeholders)
