"""Licence scans by sentences: sentences become identifiers, and identifier sequences meet ordered rules.

A text is cut into sentences and normalised. Each sentence that a pattern of the table knows becomes its
identifier; all others drop out. Wrapped lines are joined first, so that a notice may be set in lines or as a comment. Rules, in order of rank, name a licence for a sequence of identifiers; where one
matches, its identifiers are used up, so that a more general rule after it does not name the same text again.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Sentence(NamedTuple):
    id: str
    #: Of the normalised sentence: lower case, runs of other characters than letters, digits, '.', '+' and '-' as one space.
    pattern: str


class Rule(NamedTuple):
    licence: str
    #: Identifiers in a row.
    sequence: tuple[str, ...]


#: Parts of the sentences about the GNU licences.
GNU = r"general public licen[sc]e (as published by the free software foundation )?(either )?(version |v)"
LESSER = r"\b(lesser|library) "
LATER = r"( of the licen[sc]e)? or (at your option )?(any )?later\b"
#: Known licence sentences; the first that matches names the sentence.
SENTENCES = (
    Sentence("denied", r"\bnot (been )?(released|licen[sc]ed|distributed|covered|available|provided) under\b"),
    Sentence("apache2", r"\blicen[sc]ed under (the )?apache licen[sc]e (,? ?version |v)?2(\.0)?"),
    Sentence("apache2", r"\bapache licen[sc]e (version )?2\.0\b"),
    Sentence("apacheUrl", r"\bwww\.apache\.org licenses license-2\.0"),
    Sentence("lgpl3Later", LESSER + GNU + r"3(\.0)?" + LATER),
    Sentence("lgpl21Later", LESSER + GNU + r"2\.1" + LATER),
    Sentence("lgpl2Later", LESSER + GNU + r"2(\.0)?" + LATER),
    Sentence("agpl3Later", r"\baffero " + GNU + r"3(\.0)?" + LATER),
    Sentence("gpl3Later", r"\b" + GNU + r"3(\.0)?" + LATER),
    Sentence("gpl2Later", r"\b" + GNU + r"2(\.0)?" + LATER),
    Sentence("lgpl3", LESSER + GNU + "3"),
    Sentence("lgpl21", LESSER + GNU + r"2\.1"),
    Sentence("lgpl2", LESSER + GNU + "2"),
    Sentence("agpl3", r"\baffero " + GNU + "3"),
    Sentence("gpl3", r"\b" + GNU + "3"),
    Sentence("gpl2", r"\b" + GNU + "2"),
    Sentence("orLater", r"^(or at your option |either version [0-9.]+ (of the license )?or )?any later version"),
    Sentence("mit", r"\b(under|of) the (terms of the )?mit licen[sc]e\b"),
    Sentence("mitGrant", r"^permission is hereby granted free of charge to any person obtaining a copy"),
    Sentence("mitNotice", r"^the above copyright notice and this permission notice shall be included"),
    Sentence("bsd3", r"\b(3-clause|three-clause|new|modified) bsd licen[sc]e|\bbsd[- ]3-clause\b"),
    Sentence("bsd2", r"\b(2-clause|two-clause|simplified) bsd licen[sc]e|\bbsd[- ]2-clause\b"),
    Sentence("bsd", r"\bbsd licen[sc]e\b"),
    Sentence("bsdRedistribution", r"^redistribution and use in source and binary forms"),
    Sentence("bsdEndorse", r"^(neither )?the names? of .* may (not )?be used to endorse or promote"),
    Sentence("mpl2", r"\bmozilla public licen[sc]e (version |v ?)?2\.0"),
    Sentence("epl2", r"\beclipse public licen[sc]e (version |- ?v? ?|v ?)?2\.0"),
    Sentence("isc", r"\bisc licen[sc]e\b"),
    Sentence("ccZero", r"\b(cc0|creative commons zero)( 1\.0)?\b"),
    Sentence("ccByNcSa4", r"\bcc by-nc-sa 4\.0\b"),
    Sentence("ccByNcNd4", r"\bcc by-nc-nd 4\.0\b"),
    Sentence("ccByNc4", r"\bcc by-nc 4\.0\b|\bcreative commons attribution-noncommercial 4\.0"),
    Sentence("ccBySa4", r"\bcc by-sa 4\.0\b|\bcreative commons attribution-sharealike 4\.0"),
    Sentence("ccByNd4", r"\bcc by-nd 4\.0\b"),
    Sentence("ccBy4", r"\bcc by 4\.0\b|\bcreative commons attribution 4\.0"),
    Sentence("publicDomain", r"\b(released|placed|dedicated) (in|into|to) the public domain\b|\bis in the public domain\b"),
    Sentence("allRights", r"\ball rights reserved\b"),
    Sentence("someLicence", r"\b(is|are)? ?(licen[sc]ed|released|distributed) under (the )?.*licen[sc]e\b"),
)
#: In order of rank: longer and more specific sequences come first.
RULES = (
    Rule("LGPL-3.0-or-later", ("lgpl3Later",)),
    Rule("LGPL-2.1-or-later", ("lgpl21Later",)),
    Rule("LGPL-2.0-or-later", ("lgpl2Later",)),
    Rule("AGPL-3.0-or-later", ("agpl3Later",)),
    Rule("GPL-3.0-or-later", ("gpl3Later",)),
    Rule("GPL-2.0-or-later", ("gpl2Later",)),
    Rule("LGPL-3.0-or-later", ("lgpl3", "orLater")),
    Rule("LGPL-2.1-or-later", ("lgpl21", "orLater")),
    Rule("LGPL-2.0-or-later", ("lgpl2", "orLater")),
    Rule("AGPL-3.0-or-later", ("agpl3", "orLater")),
    Rule("GPL-3.0-or-later", ("gpl3", "orLater")),
    Rule("GPL-2.0-or-later", ("gpl2", "orLater")),
    Rule("Apache-2.0", ("apache2", "apacheUrl")),
    Rule("MIT", ("mitGrant", "mitNotice")),
    Rule("BSD-3-Clause", ("bsdRedistribution", "bsdEndorse")),
    Rule("LGPL-3.0", ("lgpl3",)),
    Rule("LGPL-2.1", ("lgpl21",)),
    Rule("LGPL-2.0", ("lgpl2",)),
    Rule("AGPL-3.0", ("agpl3",)),
    Rule("GPL-3.0", ("gpl3",)),
    Rule("GPL-2.0", ("gpl2",)),
    Rule("Apache-2.0", ("apache2",)),
    Rule("Apache-2.0", ("apacheUrl",)),
    Rule("MIT", ("mit",)),
    Rule("MIT", ("mitGrant",)),
    Rule("BSD-3-Clause", ("bsd3",)),
    Rule("BSD-2-Clause", ("bsd2",)),
    Rule("BSD-2-Clause", ("bsdRedistribution",)),
    Rule("BSD", ("bsd",)),
    Rule("MPL-2.0", ("mpl2",)),
    Rule("EPL-2.0", ("epl2",)),
    Rule("ISC", ("isc",)),
    Rule("CC0-1.0", ("ccZero",)),
    Rule("CC-BY-NC-SA-4.0", ("ccByNcSa4",)),
    Rule("CC-BY-NC-ND-4.0", ("ccByNcNd4",)),
    Rule("CC-BY-NC-4.0", ("ccByNc4",)),
    Rule("CC-BY-SA-4.0", ("ccBySa4",)),
    Rule("CC-BY-ND-4.0", ("ccByNd4",)),
    Rule("CC-BY-4.0", ("ccBy4",)),
    Rule("public-domain", ("publicDomain",)),
    Rule("proprietary", ("allRights",)),
    Rule("unknown-licence", ("someLicence",)),
)
#: A line goes on in the next one, behind the signs of a comment, where that begins in lower case, with a digit or a bracket.
WRAPPED = r"[\x20\x09]*\r?\n(?:#+[\x20\x09]*|//+[\x20\x09]*|[\x20\x09]+\*[\x20\x09]+|[\x20\x09]*)([a-z0-9(])"
#: It also does where it ends in a comma or a word that ends no sentence.
OPEN = r"([\x20\x09](?:the|The|of|by|under|and|or|to|in|a|an|GNU|Lesser|Library|Affero|General|Public|Apache|MIT|BSD|version|Version)|,)[\x20\x09]*\r?\n(?:#+[\x20\x09]*|//+[\x20\x09]*|[\x20\x09]+\*[\x20\x09]+|[\x20\x09]*)([A-Za-z0-9(])"
#: A sentence ends at any other line break, or at . ! ? before white space.
END = r"[\n\r]+|[.!?][\x20\x09-\x0D]+"
#: Texts without any of these have no known sentence.
HINT = r"(?i)licen[sc]e|public domain|rights reserved|permission is hereby|redistribution and use|endorse or promote|above copyright notice|any later version|\bcc0|\bcc by|creative commons|bsd[- ][23]-clause"


def normalise(x: Column) -> Column:
    lower = F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.btrim(F.regexp_replace(lower, r"[^a-z0-9.+-]+", " "), F.lit(" .-"))


def sentence_ids(text: Column) -> Column:
    """The identifiers of the known sentences, in order."""

    def known(s: Column) -> Column:
        out = F.lit("")
        for k in reversed(SENTENCES):
            out = F.when(s.rlike(k.pattern), F.lit(k.id)).otherwise(out)
        return out

    joined = F.regexp_replace(F.regexp_replace(text, WRAPPED, " $1"), OPEN, "$1 $2")
    parts = F.transform(F.filter(F.split(joined, END, -1), lambda s: s.rlike(HINT)), lambda s: normalise(s))
    return F.filter(F.transform(parts, known), lambda s: s != "")


def name(ids: Column) -> Column:
    """The licences that RULES name for identifiers joined with a blank before and after each (" a  b "), in order of rank, without repeats."""
    left, found = ids, []
    for r in RULES:
        # only blanks may lie between the identifiers of a sequence
        pattern = r" +".join(r.sequence)
        found.append(F.when(left.rlike(f" {pattern} "), F.lit(r.licence)))
        left = F.regexp_replace(left, f" {pattern} ", " # ")
    return F.array_distinct(F.array_compact(F.array(*found)))


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, sentence_ids, licences (both joined by commas; licences by rank) for each row of docs.

    Every whole text is scanned. Null, empty and other texts without known sentences give 0 and empty strings;
    repeated rows each give a row. No shuffle.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    ids = F.when(text.rlike(HINT), sentence_ids(text)).otherwise(F.array().cast("array<string>"))
    x = docs.select("doc_id", ids.alias("ids")).where(F.lit(True))
    x = x.select("doc_id", "ids", F.when(F.size("ids") > 0, F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))).otherwise("").alias("joined"))
    return x.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentence_ids"), F.when(F.col("joined") == "", F.lit("")).otherwise(F.array_join(name(F.col("joined")), ",")).alias("licences"))
