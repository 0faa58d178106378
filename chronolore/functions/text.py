"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a keyword query leaves out.
STOPWORDS = [
    "the", "and", "for", "did", "does", "was", "are", "who", "what", "when", "where", "why", "how", "our", "with", "that", "this", "has",
    "have", "any", "still", "there", "yet", "about",
]


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() takes off blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def is_blank(c: Column) -> Column:
    """True for null, empty and white space."""
    return F.coalesce(~c.rlike(r"\S"), F.lit(True))


def blank_to_null(c: Column) -> Column:
    return F.when(~is_blank(c), strip(c))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalise(c: Column) -> Column:
    """The form in which quotes are compared: white space as one blank, none at the ends, lower case."""
    return F.lower(strip(F.regexp_replace(c, r"\s+", " ")))


def normalise_name(c: Column) -> Column:
    """The form in which names are compared: a-z, 0-9 and blanks only."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""))


def keywords(c: Column) -> Column:
    """Different words of a question in order: lower case, over two characters, no stopwords."""
    words = F.split(F.lower(c), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS)))


def keyword_query(c: Column) -> Column:
    """keywords() as a disjunction."""
    return F.array_join(keywords(c), " OR ")


def is_salient(token: Column) -> Column:
    """A token with a digit, or a capitalised one of over three characters."""
    return token.rlike(r"\p{Nd}") | ((F.length(token) > 3) & token.rlike(r"^\p{Lu}"))


def salient_terms(c: Column) -> Column:
    """Dates, numbers and proper nouns of a text, each once, in order."""
    return F.array_distinct(F.filter(F.split(c, r"[^\p{L}\p{N}/]+"), lambda t: ~is_blank(t) & is_salient(t)))


def has_term(text: Column, term: Column) -> Column:
    """Whether the term stands in the text as whole words, whatever the case."""
    return F.rlike(F.lower(text), F.concat(F.lit(r"\b\Q"), F.lower(term), F.lit(r"\E\b")))


def term_coverage(answer: Column, expected: Column) -> Column:
    """Share of the salient terms of expected that the answer has; 0 if there are none."""
    terms = salient_terms(expected)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: has_term(answer, t))) / F.size(terms)).otherwise(0.0)


def opening_sentence(c: Column) -> Column:
    """Up to and with the first full stop."""
    text = strip(c)
    return F.when(F.contains(text, F.lit(".")), F.concat(F.substring_index(text, ".", 1), F.lit("."))).otherwise(text)


def clean_mention(c: Column) -> Column:
    """A name without the punctuation of the sentence around it; the point of an initial stays. Null if nothing is left."""
    name = strip(F.regexp_replace(strip(c), "[,;:]+$", ""))
    name = strip(F.regexp_replace(name, r"(?<!(^| )\p{L})\.$", ""))
    return F.when(name != "", name)


def unwrap_fence(c: Column) -> Column:
    """What stands inside a code fence, or the text itself."""
    inner = F.regexp_extract(strip(c), r"(?s)^```[^\n]*\n(.*?)\n?```$", 1)
    return F.when(strip(c).rlike(r"(?s)^```[^\n]*\n.*```$"), strip(inner)).otherwise(strip(c))


def answer_name(c: Column) -> Column:
    """The name an answer starts with, before a dash and its reason."""
    return strip(F.split(c, "—|--| - ", 2)[0])


def match_name(answer: Column, candidates: Column) -> Column:
    """The candidate (of an array) that the answer names: the same name, else one that starts with it or that it starts with."""
    name = F.lower(answer_name(answer))
    same = F.filter(candidates, lambda x: F.lower(x) == name)
    starts = F.filter(candidates, lambda x: (name != "") & (F.startswith(F.lower(x), name) | F.startswith(name, F.lower(x))))
    return F.coalesce(F.get(same, F.lit(0)), F.get(starts, F.lit(0)))


def slug(c: Column) -> Column:
    """A text as a file name of 100 characters at most."""
    plain = strip(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]', " "), r"\s+", " "))
    return F.substring(F.regexp_replace(plain, r"\.$", ""), 1, 100)


def wikilink(c: Column) -> Column:
    return F.concat(F.lit("[["), slug(c), F.lit("]]"))


def ellipsis(c: Column, most: int) -> Column:
    """At most so many characters, the last three as points if any were cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.substring(c, 1, most - 3), F.lit("...")))


def rejection_class(c: Column) -> Column:
    """The cause that a rejection message tells, for counting."""
    # Part of a message and its cause.
    causes = [("ungrounded", "ungrounded quote"), ("requires", "missing required field"), ("SUPERSEDED", "illegal status"), ("too short", "statement too short")]
    out = F.substring(c, 1, 40)
    for part, cause in reversed(causes):
        out = F.when(F.contains(c, F.lit(part)), cause).otherwise(out)
    return out


def citations(c: Column) -> Column:
    """Numbers cited as [n], each once, by first place."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int")))


def label_of(fact_type: Column) -> Column:
    """ACTION_ITEM as ActionItem."""
    return F.replace(F.initcap(F.replace(F.lower(fact_type), F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def parse_grants(comma_separated: str | None) -> list[str]:
    """Grants from a comma separated setting."""
    return list(dict.fromkeys(g.strip() for g in (comma_separated or "").split(",") if g.strip()))
