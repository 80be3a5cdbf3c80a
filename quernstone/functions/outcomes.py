"""Statements of outcomes: citations, spelled numbers, figures by what they count, a common form of paraphrases, modality."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A citation in brackets, number words, units of figures.
CITATION = r"(?i)\s*[\(\[]\s*(?:per|source|sources|see|from)?:?\s*p\d+(?:\s*[,;&]\s*(?:and\s+)?p\d+)*\s*[\)\]]"
CARDINALS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
UNITS = "day week month year hour minute".split()
# Phrasings of one meaning in order, and the clause that stands for them.
PARAPHRASES = (
    (r"\b(?:fee|charge|cost)s?\s+(?:is|are|will be|being|gets?)?\s*(?:waived|removed|dropped|not applied|not charged|not payable)\b", "no fee applies"),
    (r"\b(?:waived|exempt(?:ed)?)\s+(?:from\s+)?(?:the\s+|any\s+)?(?:fee|charge|cost)s?\b", "no fee applies"),
    (r"\b(?:no|zero|nil)\s+(?:fee|charge|cost)s?\b(?:\s+(?:applies|applied|is charged|are charged|payable|is payable|to pay))?", "no fee applies"),
    (r"\b(?:free of charge|fee[- ]free|charge[- ]free|without (?:a |any )?(?:fee|charge)|isn't charged|aren't charged|pays? nothing|nothing to pay)\b", "no fee applies"),
    (r"\b(?:not|never)\s+(?:be\s+)?charged\b", "no fee applies"),
    (r"\b(?:not|never)\s+(?:pay|incur|owe)\s+(?:a\s+|any\s+|the\s+)?(?:fee|charge|cost)s?\b", "no fee applies"),
    (r"\b(?:(?:is|are) not payable|(?:do|does|will|would) not (?:need to |have to )?pay|(?:don't|doesn't|won't) (?:need to |have to )?pay|no payment (?:is )?(?:due|needed|required))\b", "no payment due"),
    (r"\b(?:(?:is|are) payable|(?:must|need to|needs to|have to|has to|will|should) pay|payment (?:is )?(?:due|needed|required))\b", "payment due"),
    (r"\b(?:ineligible|not eligible|not entitled|(?:do|does|will|would) not qualify|(?:don't|doesn't|won't) qualify|cannot qualify|can't qualify|not qualif\w+)\b", "is ineligible"),
    (r"\b(?:eligible|entitled|qualif(?:y|ies|ied))\b", "is eligible"),
    (r"\b(?:not required|need not|no need to|(?:do|does) not need to|(?:don't|doesn't) need to|not mandatory|optional|is not obliged|are not obliged)\b", "is not required"),
    (r"\b(?:required|must|mandatory|obliged|obligatory|(?:have|has|need) to)\b", "is required"),
    (r"\b(?:not permitted|not allowed|not able to|prohibited|forbidden|barred|banned|disallowed|may not|must not|cannot|can't|can not|are not allowed to|is not allowed to|no right to)\b", "is prohibited"),
    (r"\b(?:permitted|allowed|may|can|able to|free to)\b", "is permitted"),
)
COPULA = r"\b(?:is|are|was|were|be)\s+(is\s+(?:not\s+)?(?:ineligible|eligible|required|prohibited|permitted))\b"
SUBJECT = r"\b(?:the\s+)?(?:you|your|yours|yourself|i|me|my|they|them|their|applicants?|cardholders?|customers?|account holders?|holders?|users?|clients?|claimants?|students?|residents?|people|persons?)\b"
# Words of a hedge, of what happens rather than what one may do, of prohibition, obligation and permission.
HEDGE = (
    r"(?i)\b(?:might|could|perhaps|possibly|potentially|probably|likely|unlikely|sometimes|occasionally|in (?:some|certain|a few|limited|exceptional) (?:cases|circumstances|situations|instances)|"
    r"at (?:its|our|their|the) (?:sole )?discretion|at the discretion of|subject to (?:approval|status|availability|conditions|review|eligibility|terms)|depend(?:s|ing)? on|it depends|"
    r"not (?:always|necessarily|guaranteed)|may or may not|(?:is|are) not (?:certain|clear)|unclear|(?:may|might|can sometimes|could) be able to|appears? to|seems? to|reportedly|supposedly|"
    r"can be (?:waived|reduced|refunded|removed|granted) (?:in|on|at|for)|(?:may|might) (?:also )?(?:be|get|receive|qualify|incur|owe|face|see|find))\b"
)
HAPPENS = "be get receive qualify incur owe face see find benefit obtain need have also still then sometimes usually occasionally".split()
OPEN_SUBJECTS = (
    "fee fees charge charges cost costs penalty penalties surcharge surcharges restriction restrictions condition conditions rule rules requirement requirements "
    "exception exceptions limit limits waiver waivers discount discounts this that these those it some others other"
).split()
LEFT_OPEN = "be always necessarily".split()
PROHIBITION = r"(?i)\b(?:must not|cannot|can't|can not|not (?:permitted|allowed|able)|prohibited|forbidden|barred|banned|disallowed|no right to)\b"
OBLIGATION = r"(?i)\b(?:must|shall|required to|have to|has to|need(?:s)? to|obliged|mandatory)\b"
PERMISSION = r"(?i)\b(?:can|allowed to|permitted to|permitted|entitled to|is able to|are able to)\b"
MAY = r"(?i)\bmay(\s+not)?(?:\s+(?:also|still|then))?\s+(\w+)"


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), CITATION, "")


def number_steps() -> list[tuple[str, str]]:
    """(pattern, replacement), one after the other, by which spelled numbers up to ninety-nine become digits."""
    tens = "|".join(TENS)
    steps = [(rf"\b({tens})[\s-]+{w}\b", rf"\1#{i}") for i, w in enumerate(CARDINALS) if 1 <= i <= 9]
    steps += [(rf"\b{w}#", str(i)) for i, w in enumerate(TENS, 2)]
    return steps + [(rf"\b{w}\b", str(10 * i)) for i, w in enumerate(TENS, 2)] + [(rf"\b{w}\b", str(i)) for i, w in enumerate(CARDINALS)]


def spelled_to_digits(text: Column) -> Column:
    out = text
    for pattern, by in number_steps():
        out = F.regexp_replace(out, pattern, by.replace("\\", "$"))
    return F.when(text.rlike(rf"\b({'|'.join([*TENS, *CARDINALS])})\b"), out).otherwise(text)


def figure_steps() -> list[tuple[str, str]]:
    """Thousands commas, words for per cent, currency signs and zeros at the end of decimals away."""
    return [
        (r"(\d),(\d{3})\b", r"\1\2"), (r"(\d),(\d{3})\b", r"\1\2"), (r"\b(\d+(?:\.\d+)?)\s*(?:per\s*cent|percent|pct)\b", r"\1%"), (r"[£$€]\s*(\d)", r"\1"),
        (r"\b(\d+)\.0+\b", r"\1"), (r"\b(\d+\.\d*[1-9])0+\b", r"\1"),
    ]


def figures_normal(text: Column) -> Column:
    """Figures as ``figure_steps`` writes them."""
    out = text
    for pattern, by in figure_steps():
        out = F.regexp_replace(out, pattern, by.replace("\\1\\2", "$1$2").replace("\\1", "$1"))
    return out


def canonical_steps() -> list[tuple[str, str]]:
    """From lower case on: numbers, figures, paraphrases (a sign stands for each until all have run), copulas, subjects, hyphens."""
    held = [chr(0x2460 + i) for i in range(len(PARAPHRASES))]
    steps = figure_steps() + [(p, f" {h} ") for (p, _), h in zip(PARAPHRASES, held)] + [(h, c) for (_, c), h in zip(PARAPHRASES, held)]
    steps += [(r"\s+", " "), (COPULA, r"\1"), (SUBJECT, " "), ("-", " "), (r"\s+", " "), ("^ | $", "")]
    return steps


def canonical_outcome(text: Column) -> Column:
    """The form in which outcomes are compared: lower case, no citation, figures as digits, one clause for each class of paraphrases."""
    out = spelled_to_digits(F.trim(F.lower(strip_citations(text))))
    for pattern, by in canonical_steps():
        out = F.regexp_replace(out, pattern, by.replace("\\1\\2", "$1$2").replace("\\1", "$1"))
    return out


FIGURE = r"\d+(?:\.\d+)?(?:\s*%)?[^\d]{0,40}"


def counted_figures(text: Column) -> Column:
    """Distinct ``unit value`` of a canonical text: %, a unit of time named by the next two words, else amount."""

    def one(m: Column) -> Column:
        value = F.regexp_extract(m, r"^\d+(?:\.\d+)?", 0)
        tail = F.slice(F.regexp_extract_all(m, F.lit("([a-z]+)"), F.lit(1)), 1, 2)
        unit = F.get(F.filter(F.transform(tail, lambda w: F.regexp_replace(w, "s$", "")), lambda w: w.isin(*UNITS)), F.lit(0))
        return F.concat_ws(" ", F.when(m.rlike(r"^\d+(?:\.\d+)?\s*%"), "%").otherwise(F.coalesce(unit, F.lit("amount"))), value)

    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({FIGURE})"), F.lit(1)), one))


def counts_conflict(fa: Column, fb: Column) -> Column:
    """Of two arrays of ``unit value``: some unit stands on both sides without a common figure."""
    unit = lambda f: F.split_part(f, F.lit(" "), F.lit(1))
    both = F.array_intersect(F.transform(fa, unit), F.transform(fb, unit))
    return F.exists(both, lambda u: ~F.arrays_overlap(F.filter(fa, lambda f: unit(f) == u), F.filter(fb, lambda f: unit(f) == u)))


def modality(span: Column) -> Column:
    """hedged, prohibition, obligation, permission or statement. A hedge anywhere leaves the outcome open, and so does saying nothing;
    the first ``may`` is read by what stands before and behind it."""
    s = strip_citations(span)
    what = F.lower(F.regexp_extract(s, MAY, 2))
    has, negated = s.rlike(MAY), F.regexp_extract(s, MAY, 1) != ""
    before = F.regexp_extract_all(F.lower(F.regexp_extract(s, rf"(?is)^(.*?){MAY[4:]}", 1)), F.lit("([a-z']+)"), F.lit(1))
    open_subject = F.arrays_overlap(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), 2), F.array(*map(F.lit, OPEN_SUBJECTS)))
    may = F.when(~has, "none").when(~negated & open_subject, "hedged").when(negated, F.when(what.isin(*LEFT_OPEN), "hedged").otherwise("prohibition")).when(what.isin(*HAPPENS), "hedged").otherwise("permission")
    return (
        F.when(F.trim(s) == "", "hedged").when(s.rlike(HEDGE), "hedged").when(may == "hedged", "hedged")
        .when((may == "prohibition") | s.rlike(PROHIBITION), "prohibition").when(s.rlike(OBLIGATION), "obligation")
        .when((may == "permission") | s.rlike(PERMISSION), "permission").otherwise("statement")
    )
