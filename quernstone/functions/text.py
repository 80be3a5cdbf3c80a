"""Text expressions: elements, words, tokens, sentences and normal forms."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELEMENT = r"(?s)^<(\w+)>(.*)</\1>$"
#: White space of any script, for a character class; Java and RE2 read it alike.
SPACE = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
# Heading tags, and those that open a section.
HEADINGS, TOP_HEADINGS = ("h1", "h2", "h3", "h4"), ("h1", "h2")
# Words that carry no topic.
STOP_WORDS = "a an and are as at be but by can do does for from has have how i if in is it its may must no not of on or our that the their them they this to was we what when which who will with you your".split()
# Phrases that carve an exception out of a rule, state a condition, restrict to a group, give a time, hold an opinion.
EXCEPTION_CUES = [
    "except", "unless", "excluding", "other than", "save for", "apart from", "does not apply", "do not apply", "shall not apply", "is not applicable",
    "notwithstanding", "provided that", "provided, that", "only if", "only when", "only for", "solely for", "waived for", "exempt from", "exemption",
    "carve-out", "carve out", "unless otherwise", "with the exception of", "save that",
]
CONDITION_CUES = ["subject to", "in the case of", "where the", "if the", "limited to", "provided", "for the purposes of", "in respect of"]
RESTRICTION_CUES = [
    "tier", "premium", "platinum", "signature", "gold", "silver", "bronze", "student", "senior", "resident", "non-resident", "eligible", "qualifying",
    "category", "class", "type", "holders", "members", "customers who", "accounts with", "cards with",
]
TEMPORAL_CUES = ["effective", "as of", "from 20", "until", "prior to", "before 20", "after 20", "with effect from", "no longer", "previously", "currently", "has been updated", "revised"]
OPINION_CUES = [
    "we believe", "in our view", "arguably", "many consider", "most advisers", "some argue", "regard", "widely seen", "generally considered",
    "practitioners", "critics", "reportedly", "may be seen as",
]
MODALS = r"\b(may|must|shall|can|cannot|will not|won't|should)\b"


def stripped(text: Column) -> Column:
    """Without white space of any script at its ends."""
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+$", "")


def tag_of(element: Column) -> Column:
    """The tag of ``<tag>text</tag>`` in lower case; an element without one is a paragraph."""
    e = stripped(element)
    return F.when(e.rlike(ELEMENT), F.lower(F.regexp_extract(e, ELEMENT, 1))).otherwise(F.lit("p"))


def text_of(element: Column) -> Column:
    e = stripped(element)
    return stripped(F.when(e.rlike(ELEMENT), F.regexp_extract(e, ELEMENT, 2)).otherwise(e))


def word_count(text: Column) -> Column:
    """Runs between white space of any script."""
    return F.regexp_count(text, F.lit(rf"[^{SPACE}]+")).cast("bigint")


def rendered(element: Column) -> Column:
    """List items with a dash, headings with hashes, all else as it is."""
    tag, text = tag_of(element), text_of(element)
    return F.when(tag == "li", F.concat(F.lit("- "), text)).when(tag.isin(*HEADINGS), F.concat(F.lit("## "), text)).otherwise(text)


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Distinct tokens longer than two letters that are no stop words."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def sentences(text: Column) -> Column:
    """Sentences of each line: white space squeezed, cut behind . ! ? before a capital, digit, quote or bracket."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))), lambda x: x != "")
    return F.flatten(F.transform(lines, lambda x: F.split(x, r"""(?<=[.!?]) +(?=[A-Z0-9"'(])""")))


def squad_normal(text: Column) -> Column:
    """Lower case, punctuation and articles away, white space squeezed."""
    bare = F.regexp_replace(F.lower(text), r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]""", "")
    return F.array_join(F.filter(F.split(bare, r"[ \t\n\r\f\x0B]+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def holds_tokens(text: Column, part: Column) -> Column:
    """Whether the normal form of ``part`` stands in that of ``text`` at token boundaries."""
    pad = lambda c: F.concat(F.lit(" "), squad_normal(c), F.lit(" "))
    return F.contains(pad(text), pad(part))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Part of set ``a`` that ``b`` has; 0 where ``a`` is empty."""
    own = F.size(F.array_distinct(a))
    return F.when(own > 0, F.size(F.array_intersect(a, b)) / own).otherwise(F.lit(0.0))


def cue_count(text: Column, cues: list[str]) -> Column:
    """How many of the cues the lower-cased text contains."""
    low = F.lower(text)
    return sum((F.contains(low, F.lit(c)).cast("bigint") for c in cues), F.lit(0).cast("bigint"))


def figures(text: Column) -> Column:
    """Distinct figures, without thousands commas and trailing zeros of decimals."""
    raw = F.regexp_extract_all(F.regexp_replace(text, r"(\d),(\d{3})", "$1$2"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.transform(raw, lambda x: F.regexp_replace(F.regexp_replace(x, r"(\.\d*[1-9])0+$", "$1"), r"\.0+$", "")))


def words_of(text: Column) -> Column:
    """Distinct lower-case runs of letters and apostrophes."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), F.lit(1)))


def qualifiers(text: Column) -> Column:
    """How heavily a statement is qualified: its cues, modal verbs and commas."""
    low = F.lower(text)
    return sum((cue_count(text, c) for c in (EXCEPTION_CUES, CONDITION_CUES, RESTRICTION_CUES)), F.regexp_count(low, F.lit(MODALS)).cast("bigint") + F.regexp_count(low, F.lit(",")).cast("bigint"))
