"""Licence recognition by sentences: sentences become identifiers, and sequences of these match ordered rules.

Everything is DataFrame expressions inside the row; nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The filter of LICENCE_SQL; licence_scan looks at more.
CUE = (
    r"licen[cs]|copyright|warrant|permission|permitted|redistribut|spdx|public domain|as is|liable|liabilit|"
    r"all rights reserved|creative commons|cc by|cc-by|cc0|gpl"
)

# Patterns over normalised sentences, in the order in which they are tried.
SENTENCES: list[tuple[str, str]] = [
    ("SpdxTag", r"^spdx-license-identifier "),
    ("MitGrant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    ("MitNotice", r"^the above copyright notice and this permission notice shall be included"),
    ("IscGrant", r"^permission to use copy modify and/?(or)? ?distribute this software for any purpose"),
    ("BsdUse", r"^redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdName", r"neither the name of .* may be used to endorse or promote"),
    ("ZlibGrant", r"^permission is granted to anyone to use this software for any purpose"),
    ("AsIs", r"(is|are) (provided|distributed) (on an )?as is"),
    ("NoLiability", r"in no event shall .* be liable"),
    ("UnlicenseDomain", r"this is free and unencumbered software released into the public domain"),
    ("PublicDomain", r"public domain"),
    ("AgplLater", r"affero general public license .*version 3.*any later version"),
    ("Agpl3", r"affero general public license .*version 3|agpl-?v?3"),
    ("LgplLater", r"(lesser|library) general public license .*version [23].*any later version"),
    ("Lgpl3", r"(lesser|library) general public license .*version 3|lgpl-?v?3"),
    ("Lgpl21", r"(lesser|library) general public license .*version 2(.1)?|lgpl-?v?2"),
    ("Gpl3Later", r"general public license .*version 3.*any later version|gpl-?3.0-or-later"),
    ("Gpl2Later", r"general public license .*version 2.*any later version|gpl-?2.0-or-later"),
    ("Gpl3", r"general public license .*version 3|gpl-?v?3"),
    ("Gpl2", r"general public license .*version 2|gpl-?v?2"),
    ("GplAny", r"general public license|under the gpl"),
    ("Apache2", r"apache license .*version 2|apache-2.0|apache 2.0"),
    ("ApacheAny", r"apache license"),
    ("Mpl2", r"mozilla public license .*2.0|mpl-?2.0"),
    ("Epl2", r"eclipse public license"),
    ("MitName", r"(under|with) (the )?(terms of the )?mit license|^mit license"),
    ("BsdName3", r"(3|three)-clause bsd|bsd-3-clause"),
    ("BsdName2", r"(2|two)-clause bsd|bsd-2-clause"),
    ("Cc0", r"cc0|creative commons zero"),
    ("CcByNcNd", r"(cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderiv)"),
    ("CcByNcSa", r"(cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike)"),
    ("CcByNc", r"(cc[ -]by-nc|creative commons attribution-noncommercial)"),
    ("CcByNd", r"(cc[ -]by-nd|creative commons attribution-noderiv)"),
    ("CcBySa", r"(cc[ -]by-sa|creative commons attribution-sharealike)"),
    ("CcBy", r"(cc[ -]by|creative commons attribution)"),
    ("Proprietary", r"all rights reserved|proprietary and confidential"),
    ("Copyright", r"^(copyright|\(c\))"),
    ("SeeLicence", r"see (the )?(file )?(license|copying|licence)"),
    ("UnderLicence", r"licensed under|under the .*licen[cs]e"),
]

# Rules over " Id Id ... ", in order; the first that matches names the licence.
RULES: list[tuple[str, str]] = [
    ("MIT", r" MitGrant (\w+ )*MitNotice (\w+ )*AsIs "),
    ("BSD-3-Clause", r" BsdUse (\w+ )*BsdSource (\w+ )*BsdBinary (\w+ )*BsdName "),
    ("BSD-2-Clause", r" BsdUse (\w+ )*BsdSource (\w+ )*BsdBinary "),
    ("ISC", r" IscGrant (\w+ )*AsIs "),
    ("Zlib", r" ZlibGrant "),
    ("Unlicense", r" UnlicenseDomain "),
    ("GPL OR MIT", r" (Gpl3|Gpl2|Gpl3Later|Gpl2Later) (\w+ )*(MitName|MitGrant) | (MitName|MitGrant) (\w+ )*(Gpl3|Gpl2|Gpl3Later|Gpl2Later) "),
    ("Apache-2.0 OR MIT", r" Apache2 (\w+ )*(MitName|MitGrant) | (MitName|MitGrant) (\w+ )*Apache2 "),
    ("AGPL-3.0-or-later", r" AgplLater "),
    ("AGPL-3.0", r" Agpl3 "),
    ("LGPL-or-later", r" LgplLater "),
    ("LGPL-3.0", r" Lgpl3 "),
    ("LGPL-2.1", r" Lgpl21 "),
    ("GPL-3.0-or-later", r" Gpl3Later "),
    ("GPL-2.0-or-later", r" Gpl2Later "),
    ("GPL-3.0", r" Gpl3 "),
    ("GPL-2.0", r" Gpl2 "),
    ("GPL", r" GplAny "),
    ("Apache-2.0", r" Apache2 "),
    ("Apache", r" ApacheAny "),
    ("MPL-2.0", r" Mpl2 "),
    ("EPL", r" Epl2 "),
    ("MIT", r" (MitName|MitGrant) "),
    ("BSD-3-Clause", r" BsdName3 "),
    ("BSD-2-Clause", r" BsdName2 "),
    ("BSD", r" BsdUse "),
    ("CC0-1.0", r" Cc0 "),
    ("CC-BY-NC-ND", r" CcByNcNd "),
    ("CC-BY-NC-SA", r" CcByNcSa "),
    ("CC-BY-NC", r" CcByNc "),
    ("CC-BY-ND", r" CcByNd "),
    ("CC-BY-SA", r" CcBySa "),
    ("CC-BY", r" CcBy "),
    ("public-domain", r" PublicDomain "),
    ("proprietary", r" Proprietary "),
    ("unknown", r" (SpdxTag|UnderLicence|SeeLicence) "),
]

SENTENCE_END = r"([.!?])[\x20\x09-\x0D]+"
_GAP = r"[\x20\x09-\x0D]+"
#: Characters that a normal sentence keeps; dots between digits stay, so that versions do.
_OTHER = r"[^a-z0-9()+./-]+"
_CLOSING = r"[.]+( |$)"


#: Each pattern of SENTENCES needs one of these, in any case: other texts aren't split.
_NEEDS = (
    r"(?i)spdx|permission|redistribution|neither the|provided|distributed|in no event|in[^a-z]+no[^a-z]+event|unencumbered|public|"
    r"licen[cs]e|gpl|apache|mpl|bsd|cc0|creative|cc[^a-z0-9]+by|reserved|proprietary|copyright|\(c\)|copying|neither"
)
#: A line that begins so begins a sentence, after any comment marks.
_STARTS = (
    r"permission is|permission to use|the above copyright|redistributions? |neither the name|copyright[ \t]+(?:\(c\)|\u00a9|[0-9])|\(c\)|mit license|"
    r"the software is provided|this software is provided|in no event"
)
#: Sentence ends inside blocks: blank lines (of comment marks as well), lines that end in a colon, and list markers.
_BLOCKS = [
    (r"\r\n?", "\n"),
    (r"(?im)^([^\n]*spdx-license-identifier[^\n]*)$", "\n\n$1\n\n"),  # from a line's beginning alone: long lines take linear time
    (r"\n[ \t#*/;%-]*(?=\n)", "\n\n"),
    (r":[ \t]*\n", ":\n\n"),
    (r"\n(?=[ \t#*/;%]*(?:[-\u2022]|\(?[0-9a-zA-Z]{1,2}[.)])[ \t])", "\n\n"),
    (rf"(?i)\n(?=[ \t#*/;%\"-]*(?:{_STARTS}))", "\n\n"),
    (SENTENCE_END, "$1\n\n"),
]
_SPDX = "spdx-license-identifier "
# SPDX identifiers, normalised, and the sentence that names the same licence.
SPDX: list[tuple[str, str]] = [
    ("MitName", r"^mit$"),
    ("Apache2", r"^apache-2[.]0$"),
    ("Mpl2", r"^mpl-2[.]0"),
    ("Epl2", r"^epl-"),
    ("AgplLater", r"^agpl-3[.]0(-or-later|[+])$"),
    ("Agpl3", r"^agpl-3[.]0"),
    ("LgplLater", r"^lgpl-[23][.][01](-or-later|[+])$"),
    ("Lgpl3", r"^lgpl-3[.]0"),
    ("Lgpl21", r"^lgpl-2[.][01]"),
    ("Gpl3Later", r"^gpl-3[.]0(-or-later|[+])$"),
    ("Gpl2Later", r"^gpl-2[.]0(-or-later|[+])$"),
    ("Gpl3", r"^gpl-3[.]0"),
    ("Gpl2", r"^gpl-2[.]0"),
    ("BsdName3", r"^bsd-3-clause"),
    ("BsdName2", r"^bsd-2-clause"),
    ("IscGrant AsIs", r"^isc$"),
    ("ZlibGrant", r"^zlib$"),
    ("UnlicenseDomain", r"^unlicense$"),
    ("Cc0", r"^cc0-"),
    ("CcByNcNd", r"^cc-by-nc-nd"),
    ("CcByNcSa", r"^cc-by-nc-sa"),
    ("CcByNc", r"^cc-by-nc"),
    ("CcByNd", r"^cc-by-nd"),
    ("CcBySa", r"^cc-by-sa"),
    ("CcBy", r"^cc-by"),
]
#: What a part of a wrapped sentence may give alone: the whole sentence says more.
_PARTS = ["Copyright", "GplAny", "ApacheAny", "UnderLicence", "SeeLicence", "PublicDomain", "Proprietary", "Gpl2", "Gpl3", "Lgpl3", "Lgpl21", "Agpl3"]


def _known(values: Column, table: list[tuple[str, str]]) -> Column:
    return F.filter(F.transform(values, lambda x: _first(x, table)), lambda x: x.isNotNull())


def _named(sentences: Column) -> Column:
    """(tag, whole, lines, named) of the sentences (text, lines): what the whole, each line and an SPDX tag's operands name."""
    return F.transform(
        sentences,
        lambda x: F.struct(
            x["text"].contains(_SPDX).alias("tag"),
            _first(x["text"], SENTENCES).alias("whole"),
            _known(x["lines"], SENTENCES).alias("lines"),
            _known(F.split(F.regexp_replace(F.regexp_extract(x["text"], f"{_SPDX}(.*)$", 1), "[()]", ""), " +", -1), SPDX).alias("named"),
        ),
    )


def _identifiers(x: Column) -> Column:
    """The identifiers of a sentence, which may be wrapped: those of its lines, and first its own if no line has it."""
    return (
        F.when(x["tag"], F.concat(F.array(F.lit("SpdxTag")), x["named"]))
        .when(x["whole"].isNull() | F.array_contains(x["lines"], x["whole"]), x["lines"])
        .otherwise(F.concat(F.array(x["whole"]), F.filter(x["lines"], lambda y: ~y.isin(_PARTS))))
    )


def normal_sentence(s: Column) -> Column:
    plain = F.regexp_replace(F.lower(s), _OTHER, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(plain, _CLOSING, " "), " +", " "))


def _first(value: Column, table: list[tuple[str, str]]) -> Column:
    found = None
    for name, pattern in table:
        test = value.rlike(pattern)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found


def licence_scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """(doc_id, sentence_ids, n_sentences, licence) for each row of docs.

    Sentences may be wrapped: they end at .!?, blank lines, colons at a line's end, list markers and known beginnings.
    sentence_ids are the known sentences of the text in order, joined by blanks; licence is the first rule that
    their sequence matches, null if none.  Null and empty texts have no sentences.  doc_id may be null or
    repeat; each row is scanned by itself.
    """
    text = F.coalesce(F.col(column), F.lit(""))
    blocks = text
    for pattern, to in _BLOCKS:
        blocks = F.regexp_replace(blocks, pattern, to)
    sentences = F.when(
        text.rlike(_NEEDS), F.filter(F.transform(F.split(blocks, "\n{2,}", -1), lambda s: F.btrim(s, F.lit("\n"))), lambda s: s.rlike(_NEEDS))
    ).otherwise(F.array().cast("array<string>"))
    rows = docs.select("doc_id", sentences.alias("tm_sentences"))
    rows = rows.select(
        "doc_id",
        F.transform(
            "tm_sentences",
            lambda s: F.struct(normal_sentence(s).alias("text"), F.transform(F.split(s, "\n", -1), normal_sentence).alias("lines")),
        ).alias("tm_normal"),
    )
    rows = rows.select("doc_id", _named(F.col("tm_normal")).alias("tm_named"))
    rows = rows.select("doc_id", F.array_join(F.flatten(F.transform("tm_named", _identifiers)), " ").alias("sentence_ids"))
    sequence = F.concat(F.lit(" "), F.col("sentence_ids"), F.lit(" "))
    return rows.select(
        "doc_id",
        "sentence_ids",
        F.when(F.col("sentence_ids") == "", 0).otherwise(F.size(F.split("sentence_ids", " ", -1))).cast("long").alias("n_sentences"),
        _first(sequence, RULES).alias("licence"),
    )


def _case(value: str, table: list[tuple[str, str]]) -> str:
    quote = lambda x: x.replace("'", "''")
    return "CASE " + " ".join(f"WHEN regexp_matches({value}, '{quote(p)}') THEN '{n}'" for n, p in table) + " END"


LICENCE_SQL = rf"""
WITH s AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '{SENTENCE_END}', '\1' || chr(10), 'g'), chr(10)),
                             lambda x: regexp_matches(x, '(?i){CUE}')) AS sents
  FROM documents
), n AS (
  SELECT doc_id, list_transform(sents, lambda x: trim(regexp_replace(regexp_replace(regexp_replace(
    lower(x), '{_OTHER}', ' ', 'g'), '{_CLOSING}', ' ', 'g'), ' +', ' ', 'g'))) AS normal
  FROM s
), k AS (
  SELECT doc_id, array_to_string(list_filter(list_transform(normal, lambda x: {_case("x", SENTENCES)}), lambda x: x IS NOT NULL), ' ') AS ids
  FROM n
)
SELECT doc_id, coalesce(ids, '') AS sentence_ids,
  CASE WHEN coalesce(ids, '') = '' THEN 0 ELSE len(string_split(ids, ' ')) END::BIGINT AS n_sentences,
  {_case("(' ' || coalesce(ids, '') || ' ')", RULES)} AS licence
FROM k
"""
