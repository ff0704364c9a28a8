"""English lemmas by ordered suffix rules and a table of irregular forms.

A word takes the first rule whose pattern it matches; a word that matches none is its own lemma.
The rules undo regular plurals, third persons, past forms and -ing forms, one part of the ending
after the other: an ending that is none (-ss, -us, -is, -eed), doubled consonants, a dropped e
(after endings that need one, and after a short stem of one vowel and one consonant), y for
i. Irregular forms and words that only look inflected are in ``lexicons/lemmas_en.tsv``.

One list serves Spark (one native expression per token), SQL and Python. Patterns are written
for ASCII lower-case letters, without look-around, so all engines read them alike. It is a
heuristic without parts of speech: a noun such as "building" becomes "build".
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Only words with these endings can match a rule.
GATE = "(s|ed|ing)$"

_VOWEL = "[aeiouy]"
# A dropped e comes back after these ends of a stem ...
_NEEDS_E = ("(?:[a-z]*(?:[aeiouy][a-z]*at|iat|uat|iz|yz|[cvu]|[bcdfgkpstz]l|[bcdfgklmnprst]i[vsz]|[rndl]g|[aiou]dg|eng|[aeiou]ns|"
            "[aeiou]rs|[^aeiou]aus|ais|[ae]as|[eo]os|[bcdfhlmnprtvx][aeiou]s|owz|yp|ys|um|uir|quir|plor|[cdfmnp]lar|[cpm]par|epar|"
            "[tcsx]ur|[spm]ir|[dg]min|[mf]in|bin|gin|[vcsl]id|gui?d|cit|vit|nit|[pl]et|rib|nc|gram)|"
            "[bcdfghjklmnpqrstvwxz]{0,3}(?:qu)?[aeiouy][bcdfgklmnprstvz])")
_STEM = f"([a-z]*{_VOWEL}[a-z]*)"


def _endings(ending: str) -> list[tuple[str, str]]:
    """Rules for words of a stem with a vowel and ``ending`` (ed, ing)."""
    return [
        (f"^([a-z]*{_VOWEL}[a-z]*(?:ll|ss|zz|ff)){ending}$", r"\1"),
        *[(f"^([a-z]*{_VOWEL}[a-z]*{c}){c}{ending}$", r"\1") for c in "bdgmnprt"],
        (f"^({_NEEDS_E}){ending}$", r"\1e"),
        (f"^{_STEM}{ending}$", r"\1"),
    ]


RULES: tuple[tuple[str, str], ...] = (
    # -s: plurals and third persons.
    ("^([a-z]*(?:ss|us|is|news|series|species|as|os))$", r"\1"),
    ("^([a-z]{2,})ies$", r"\1y"),
    ("^([a-z]+(?:ss|x|ch|sh|zz))es$", r"\1"),
    ("^([a-z]+[bcdfghjklmnpqrstvwxz]o)es$", r"\1"),
    ("^([a-z]+(?:el|al|ol|ar|ea|oa|ho|ha|l))ves$", r"\1f"),
    ("^([a-z]{2,})s$", r"\1"),
    # -ed and -ing.
    ("^([a-z]{2,})ied$", r"\1y"),
    ("^([a-z]*eed)$", r"\1"),
    *_endings("ed"),
    *_endings("ing"),
)


def lemma_sql(token: str, pairs) -> str:
    """The lemma of a SQL expression (regular expressions in RE2 syntax)."""
    def lit(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"
    whens = [f"WHEN {token} = {lit(a)} THEN {lit(b)}" for a, b in pairs]
    whens.append(f"WHEN NOT regexp_matches({token}, {lit(GATE)}) THEN {token}")
    whens += [f"WHEN regexp_matches({token}, {lit(p)}) THEN regexp_replace({token}, {lit(p)}, {lit(r)})" for p, r in RULES]
    return f"(CASE {' '.join(whens)} ELSE {token} END)"


def lemma(token: Column, pairs) -> Column:
    """The lemma of a token column; ``pairs`` are the irregular forms."""
    out = token
    for pattern, result in reversed(RULES):
        out = F.when(token.rlike(pattern), F.regexp_replace(token, pattern, result.replace("\\", "$"))).otherwise(out)
    out = F.when(token.rlike(GATE), out).otherwise(token)
    if pairs:
        # Hash-set test first (InSet); only irregular forms pay for the map lookup.
        table = F.create_map(*[F.lit(x) for p in pairs for x in p])
        out = F.when(token.isin([a for a, _ in pairs]), F.try_element_at(table, token)).otherwise(out)
    return out


def python_lemma(token: str, pairs: dict[str, str]) -> str:
    if token in pairs:
        return pairs[token]
    if re.search(GATE, token):
        for pattern, result in RULES:
            if re.match(pattern, token):
                return re.sub(pattern, result, token, count=1)
    return token
