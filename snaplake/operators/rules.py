"""Row rules as columns: filters, ordered classification, buckets, keys."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def any_substring(column: str | Column, words: Sequence[str]) -> Column:
    """Whether any word is in the text, whatever its case; no words: true."""
    if not words:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(F.lower(column), w))


def matches(title: str, location: str, keywords: Sequence[str], places: Sequence[str]) -> Column:
    return any_substring(title, keywords) & any_substring(location, places)


def matches_or_trusted(title: str, location: str, trusted: Column, keywords: Sequence[str], places: Sequence[str]) -> Column:
    """A trusted search needs no title keyword; the place still counts."""
    return (trusted | any_substring(title, keywords)) & any_substring(location, places)


def may_match_place(location: str, places: Sequence[str]) -> Column:
    """Keep what matches and what cannot be told yet: nothing stated, or only a number of locations."""
    c = F.lower(F.coalesce(F.col(location), F.lit("")))
    return F.lit(True) if not places else (c == "") | c.rlike(r"^\s*[0-9]+\s+locations\s*$") | any_substring(c, places)


def whole_word(column: str | Column, word: str) -> Column:
    """``word`` with no letter on either side, whatever its case."""
    quoted = re.sub(r"([^a-z0-9 ])", r"\\\1", word.lower())
    return F.lower(column).rlike(f"(?<![a-z]){quoted}(?![a-z])")


# In the patterns of this module digits are [0-9]: Java, Python and DuckDB disagree on which other digits \d takes.


def first_match(rules: Sequence[tuple[str, str, Sequence[str]]], *texts: str) -> Column:
    """``struct(name, part1, part2, part3)`` of the first rule that is found in the first text, else of the first in the second, ...

    A rule is (name, regex, captures to keep as parts), where a capture is a group number as text; missing parts are empty.
    """
    cases = []
    for text in texts:
        for name, pattern, captures in rules:
            parts = [F.regexp_extract(text, pattern, int(g)) for g in captures] + [F.lit("")] * (3 - len(captures))
            cases.append(F.when(F.col(text).rlike(pattern), F.struct(F.lit(name).alias("name"), parts[0].alias("part1"), parts[1].alias("part2"), parts[2].alias("part3"))))
    return F.coalesce(*cases)


# What careers platforms leave in addresses and pages, in the order in which they are tried.
CAREER_PLATFORMS = [
    ("workday", r"https?://([a-z0-9-]+)\.(wd[0-9]+)\.myworkday(?:jobs|site)\.com/(?:[a-z]{2}-[A-Z]{2}/)?(?:recruiting/[a-z0-9-]+/)?([A-Za-z0-9_-]+)", ["1", "2", "3"]),
    ("oracle", r"https?://([a-z0-9-]+\.fa(?:\.[a-z0-9-]+)?\.oraclecloud\.com)/hcmUI/CandidateExperience/[a-z]{2}/sites/([A-Za-z0-9_]+)", ["1", "2"]),
    ("greenhouse", r"(?:boards(?:-api)?\.greenhouse\.io/(?:embed/job_board\?for=|v1/boards/)?|job-boards\.greenhouse\.io/)([a-z0-9_-]+)", ["1"]),
    ("lever", r"jobs\.lever\.co/([a-z0-9_-]+)", ["1"]),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)", ["1"]),
    ("eightfold", r"https?://([a-z0-9.-]+)/careers\?[^\"']*domain=([a-z0-9.-]+)|([a-z0-9-]+)\.eightfold\.ai", ["1", "2", "3"]),
    ("successfactors", r"(career[0-9]*\.successfactors\.(?:com|eu)|rmkcdn\.successfactors\.com)", []),
    ("icims", r"([a-z0-9-]+)\.icims\.com", []),
    ("phenom", r"(phenompeople\.com|cdn\.phenompeople)", []),
    ("avature", r"([a-z0-9-]+)\.avature\.net", []),
    ("taleo", r"([a-z0-9-]+)\.taleo\.net", []),
    ("darwinbox", r"([a-z0-9-]+)\.darwinbox\.in", []),
]


def ordered_case(cases: Sequence[tuple[str, Column]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = F.when(cases[0][1], F.lit(cases[0][0]))
    for label, condition in cases[1:]:
        out = out.when(condition, F.lit(label))
    return out.otherwise(F.lit(otherwise))


# City spellings, seniority words, industry words and what counts as "not stated".
CITIES = [("Bengaluru", "bengaluru|bangalore"), ("Hyderabad", "hyderabad"), ("Pune", "pune"), ("Mumbai", "mumbai"), ("Delhi NCR", "gurugram|gurgaon|noida|delhi"), ("Chennai", "chennai"), ("Remote", "remote")]
SR = "senior|(^|[^a-z])sr([^a-z]|$)"
LEVELS_STATED = [("Manager", "manager|head|director"), ("Lead", "lead|principal|staff|architect"), ("Senior", SR), ("Mid", "mid|intermediate"), ("Junior", "junior|entry|graduate|fresher")]
LEVELS_IN_TITLE = [("Manager", "manager|head of|director"), ("Lead", "lead|principal|staff|architect"), ("Senior", SR), ("Junior", "junior|graduate|intern|trainee")]
INDUSTRIES = [
    ("Healthcare & life sciences", "health|pharma|life science|medic|clinic|hospital|biotech"),
    ("Banking & financial services", "bank|financ|fintech|payment|capital market|trading|wealth"),
    ("Insurance", "insur"),
    ("Consulting & IT services", "consult|professional services|it services|outsourc"),
    ("Retail & consumer", "retail|e-?commerce|consumer|cpg|fmcg"),
    ("Energy & manufacturing", "energy|utilit|oil|gas|manufactur|automotive|industrial"),
    ("Telecom & media", "telecom|media|entertain|gaming"),
    ("Public sector", "government|public sector"),
    ("Cybersecurity", "secur|identity|(^|[^a-z])iam([^a-z]|$)|cyber"),
]
TECHNOLOGY = "data|(^|[^a-z])ai([^a-z]|$)|analytic|software|technolog|cloud|saas|engineering|streaming"
NOT_STATED = ["", "unknown", "n/a", "na", "none", "not specified", "null"]
PLATFORMS = {"workday": "Workday", "greenhouse": "Greenhouse", "lever": "Lever", "amazon": "Amazon Jobs", "eightfold": "Eightfold", "oracle": "Oracle Recruiting", "successfactors": "SAP SuccessFactors", "manual": "Pasted JD"}


def regex_cases(column: str, rules: Sequence[tuple[str, str]]) -> list[tuple[str, Column]]:
    return [(label, F.lower(column).rlike(pattern)) for label, pattern in rules]


def city(location: str) -> Column:
    return ordered_case(regex_cases(location, CITIES), "Other")


def level(stated: str, title: str) -> Column:
    """The stated level, else what the title says."""
    return F.coalesce(ordered_case(regex_cases(stated, LEVELS_STATED)), ordered_case(regex_cases(title, LEVELS_IN_TITLE)), F.lit("Not stated"))


def found(low: Column, pattern: str) -> Column:
    """Whether a lowered text has one of a pattern's alternatives: words are looked for as bytes, and other alternatives are tried only where the longest word that they need is."""
    tests = []
    for part in re.split(r"\|(?![^(]*\))", pattern):
        needs = max(re.sub(r"\(.*?\)|\[.*?\]|.\?", "|", part).split("|"), key=len)
        known = re.fullmatch(r"(?:\([^()*+{}\\.]*\)|[^()*+{}\\.])+", part) and re.fullmatch("[a-z0-9 -]+", needs)
        tests.append(low.rlike(part) if not known else F.contains(low, F.lit(part)) if needs == part else F.contains(low, F.lit(needs)) & low.rlike(part))
    return reduce(lambda a, b: a | b, tests)


def industry(text: str) -> Column:
    """One industry if one matches; several are "Multiple industries"; none may still be technology, or nothing stated."""
    low = F.lower(text)
    named = F.concat_ws("|", *[F.when(found(low, pattern), F.lit(label)) for label, pattern in INDUSTRIES])
    one = F.nullif(F.regexp_replace(named, r"^.*\|.*$", "Multiple industries"), F.lit(""))
    rest = F.when(found(low, TECHNOLOGY), "Technology & software").when(F.col(text).isNull() | F.trim(low).isin(NOT_STATED), "Not stated").otherwise("Other")
    return F.coalesce(one, rest)


def age_bucket(days: Column) -> Column:
    """A null age counts as old."""
    return F.when(days <= 7, "New (7 days or less)").when(days <= 30, "Recent (8-30 days)").otherwise("Older (over 30 days)")


def labelled(column: str | Column, labels: Mapping[str, str]) -> Column:
    """The label of a code; a code without one passes."""
    c = F.col(column) if isinstance(column, str) else column
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def stable_key(source: str, company: str, identity: str) -> Column:
    """16 hex digits that name a record for ever; a missing part prints as ``None``."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in (source, company, identity)]
    return F.substring(F.sha1(F.lower(F.concat_ws("|", *parts))), 1, 16)


def differs(a: str | Column, b: str | Column) -> Column:
    """Null-safe inequality."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return ~a.eqNullSafe(b)


def or_default(column: str, default: str) -> Column:
    """A blank or missing value becomes ``default``."""
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def place(city_column: str, country_column: str) -> Column:
    """City and country; the country is not said twice."""
    c, k = (F.coalesce(F.col(x), F.lit("")) for x in (city_column, country_column))
    return F.when((k != "") & F.contains(F.lower(c), F.lower(k)), c).otherwise(F.concat_ws(", ", F.nullif(c, F.lit("")), F.nullif(k, F.lit(""))))


def union_sources(*frames: DataFrame) -> DataFrame:
    """One record shape from many sources: columns by name, missing ones null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
