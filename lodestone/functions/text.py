"""Text functions over columns; all run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Function words that are no search terms (English, Filipino, Indonesian).
STOP_WORDS = (
    "the a an of to and or is are in on for with at by be it this that as from we you your our i my do does can what how any who whose whom which where when why "
    "would could should will want need get much many there about me us they their them if not no yes ok please tell know like just also than then so but am was "
    "were been has have had into out up down over its he she his her say said "
    "ang ng sa na ay mga po opo yung lang naman kung para ako ko mo ka ba ho siya namin natin kayo sila "
    "yang dan di ke ini itu pak bu ya dong sih nya ada tidak bisa untuk dengan dari pada atau juga saya anda kami kita sudah"
).split()
TOKEN = r"[a-z0-9]+(?:[-'][a-z0-9]+)?"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
# Field names that mean the same, as they are looked up: without underscores first, then with them.
FIELD_NAMES = {
    "dob": "date_of_birth", "dateofbirth": "date_of_birth", "date_of_birth": "date_of_birth",
    "fullname": "full_name", "name": "full_name", "member_name": "member_name",
    "mobile_no": "mobile_number", "mobile": "mobile_number", "phone": "mobile_number",
    "emailid": "email", "email": "email", "pincode": "pin_code", "pin": "pin_code",
    "policyterm": "policy_term", "sum_insured": "sum_insured", "sum_insured_rs": "sum_insured",
    "annual_premium_rs_excl_gst": "annual_premium_excl_gst",
}
# How a question begins, and how one begins on a call.
QUESTION = "what how can is do does who when why will are".split()
ASCII_LETTERS = "A-Za-z0-9_"
ASKED = [*QUESTION, *"magkano ano pwede boleh berapa apakah".split()]
# Terminology rewrites, in order.
TERMS = [
    (r"(?i)\bcash[\s-]?less hospitali[sz]ation\b", "cashless hospitalisation"),
    (r"(?i)\bhospitalization\b", "hospitalisation"),
    (r"(?i)\bhospitalized\b", "hospitalised"),
    (r"(?i)\bco[\s-]?pay(?:ment)?s?\b", "co-payment"),
    (r"(?i)\bcopayment\b", "co-payment"),
    (r"(?i)\bpre[\s-]?existing (?:disease|condition)s?\b", "pre-existing disease"),
    (r"\bPEDs?\b", "pre-existing disease"),
    (r"(?i)\bno[\s-]?claim bonus\b", "no-claim bonus"),
    (r"(?i)\bupto\b", "up to"),
    (r"(?i)\blife[\s-]?time renewab", "lifetime renewab"),
    (r"(?i)\bhealth check[\s-]?ups?\b", "health check-up"),
    (r"(?i)\bsum assured\b", "sum insured"),
    (r"(?i)\bRs\.?\s?(\d[\d,.]*)\s?(?:lacs?|lakhs?|L)\b", "Rs $1 lakh"),
    (r"(?i)\b(\d[\d,.]*)\s?lacs?\b", "$1 lakh"),
    (r"\b(\d+)\s?%", "$1%"),
    (r"(?i)\byrs?\b", "years"),
    (r"(?i)\bu/s\s+80D\b", "under Section 80D"),
    (r"\bTAT\b", "turnaround time"),
    (r"\bPPME\b", "pre-policy medical examination"),
]
_NAMED = "((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6})"
# Forms of a document's date, with the groups of year, month and day (0: the first of the month).
DATE_FORMS = [
    (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3),
    (r"\b(\d{1,2})/(\d{1,2})/(\d{4})\b", 3, 2, 1),
    (r"(?i)\b(\d{1,2})-(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)-(\d{4})\b", 3, 2, 1),
    (rf"\b{_NAMED}\s+(\d{{1,2}}),\s+(\d{{4}})\b", 3, 1, 2),
    (rf"\b(\d{{1,2}})\s+{_NAMED}\s+(\d{{4}})\b", 3, 2, 1),
    (rf"\b{_NAMED}[\s-](\d{{4}})\b", 2, 1, 0),
]


def replace_each(text: Column, pattern: str, of) -> Column:
    """The text with each match of the pattern replaced by of(match), in one pass from the left."""

    def joined(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), of)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")

    # The text is computed once for a row, however often it is asked for: replacements in turn would double the work of each before.
    return let(text, lambda t: F.when(t.rlike(pattern), joined(t)).otherwise(t))


def normalize_whitespace(text: Column) -> Column:
    """One kind of blank, apostrophe and dash; no blanks in a row or around a line end, no white space at either end."""
    one = F.translate(text, "\u00a0\u2019\u2013\u2014", " '--")
    # A single blank is no match, as it would be replaced by itself.
    return F.btrim(F.regexp_replace(F.regexp_replace(one, r"[ \t]{2,}|\t", " "), r" \n ?|\n ", "\n"), F.lit(" \t\n\x0b\f\r"))


def _iso(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month.cast("int").cast("string"), 2, "0"), F.lpad(day.cast("int").cast("string"), 2, "0"))


def _month(name: Column) -> Column:
    """1 to 12 by the first three letters, else 0."""
    return F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(name, 1, 3)))


# Dates that are rewritten, one form after the other: 31/12/2024, Dec 31, 2024 and 31st Dec 2024.
_DAY_MONTH_YEAR = r"(?=\d)\b(\d{1,2})/(\d{1,2})/(\d{4})\b"
_NAME_DAY_YEAR = r"(?=[A-Z])\b([A-Z][a-z]{2,8})\s+(\d{1,2}),\s+(\d{4})\b"
_DAY_NAME_YEAR = r"(?=\d)\b(\d{1,2})(?:st|nd|rd|th)?[\s-]([A-Za-z]{3,9}),?[\s-](\d{4})\b"


def normalize_dates(text: Column) -> Column:
    """Dates become 2024-12-31; a day over 31 or a month over 12 in numbers, and unknown month names, stay as they are."""

    def numbers(m: Column) -> Column:
        day, month, year = (F.regexp_extract(m, _DAY_MONTH_YEAR, i) for i in (1, 2, 3))
        return F.when(day.cast("int").between(1, 31) & month.cast("int").between(1, 12), _iso(year, month, day)).otherwise(m)

    def named(pattern: str, name: int, day: int):
        def of(m: Column) -> Column:
            n = _month(F.regexp_extract(m, pattern, name))
            return F.when(n > 0, _iso(F.regexp_extract(m, pattern, 3), n, F.regexp_extract(m, pattern, day))).otherwise(m)

        return of

    out = replace_each(text, _DAY_MONTH_YEAR, numbers)
    out = replace_each(out, _NAME_DAY_YEAR, named(_NAME_DAY_YEAR, 1, 2))
    return replace_each(out, _DAY_NAME_YEAR, named(_DAY_NAME_YEAR, 2, 1))


def rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    """(pattern, replacement) applied one after the other: a later rule sees what an earlier one wrote."""
    return reduce(lambda t, r: F.regexp_replace(t, _guarded(r[0]), r[1]), rules, text)


def _guarded(pattern: str) -> str:
    """The pattern, which finds the same: where it begins with the edge of a word and an ASCII letter or a digit, that character is
    looked for first, as Java takes long to tell whether a place is an edge."""
    head = re.match(r"(?:\(\?i\))?\\b(?:([A-Za-z])(?![?*{|])|\((\\d)(?![?*{]))", pattern)
    level = 0
    for c in re.sub(r"\\.|\[[^]]*\]", "", pattern):
        level += (c == "(") - (c == ")")
        if c == "|" and level == 0:
            return pattern
    if head is None or head[2] and re.search(r"\)[?*{]", pattern):
        return pattern
    first = head[2] or f"[{head[1].lower()}{head[1].upper()}]"
    return f"(?={first}){pattern}"


def normalize_terms(text: Column, rules: list[tuple[str, str]] = TERMS, names: list[str] = ()) -> Column:
    """One term for each thing; of `names`, those written in capitals get their usual form."""
    return rewrite(text, [*rules, *((rf"\b{re.escape(n.upper())}\b", n) for n in names)])


def normalize_text(text: Column, rules: list[tuple[str, str]] = TERMS, names: list[str] = ()) -> Column:
    """White space, then dates, then terms."""
    return normalize_terms(normalize_dates(normalize_whitespace(text)), rules, names)


def title_case(text: Column) -> Column:
    """Each run of letters with a capital first and small letters after."""
    return replace_each(F.lower(text), r"\p{L}+", lambda m: F.initcap(m))


def _capitals(text: Column) -> Column:
    return (F.upper(text) == text) & (F.lower(text) != text)


def standardize_heading(h: Column) -> Column:
    """Without number or section prefix; capitals become title case, other words a capital first, short acronyms stay."""
    h = F.regexp_replace(normalize_whitespace(h), r"(?i)^section\s+[a-z]\s*-\s*", "")
    # Only a capital or a number counts as a prefix; what goes with it is looked for without regard to case.
    bare = F.regexp_replace(h, r"(?i)^(?:section\s+)?(?:[a-z]|\d+)(?:\.\d+)*[.)\s-]+\s*", "")
    h = F.regexp_replace(F.when(h.rlike(r"^(?:[A-Z]|\d+)(?:\.\d+)*[.)\s-]"), bare).otherwise(h), r"^[ :-]+|[ :-]+$", "")
    words = F.transform(F.split(h, " "), lambda w: F.when(_capitals(w) & (F.length(w) <= 5), w).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1000000))))
    return F.when(_capitals(h), title_case(h)).otherwise(F.array_join(words, " "))


def standardize_field_name(name: Column) -> Column:
    snake = F.regexp_replace(F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_")), r"[-_ ]+", "_")
    known = F.create_map(*(F.lit(x) for kv in FIELD_NAMES.items() for x in kv))
    return F.coalesce(known[F.regexp_replace(snake, "_", "")], known[snake], snake)


def slug(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(path), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def version_of(text: Column) -> Column:
    """The first version number (2.1 or 2024.3, after "version" or "v") in the first 800 characters; 1.0 without one."""
    v = F.regexp_extract(F.substring(text, 1, 800), r"(?i)\b(?:version|v)\s*([0-9]+(?:\.[0-9]+)+|[0-9]{4}\.[0-9]+)\b", 1)
    return F.when(v == "", "1.0").otherwise(v)


def first_date(text: Column) -> Column:
    """The date, ISO, that stands first in the first 600 characters, in any of the forms; at the same place the earlier form's.
    Null without one."""

    def found(head: Column) -> Column:
        rows = []
        for i, (p, year, month, day) in enumerate(DATE_FORMS):
            part = lambda g: F.regexp_extract(head, p, g)  # noqa: B023, E731
            at = _month(part(month))
            number = F.when(at > 0, at.cast("string")).otherwise(part(month))
            iso = F.concat_ws("-", part(year), F.lpad(number, 2, "0"), F.lpad(part(day), 2, "0") if day else F.lit("01"))
            place = F.regexp_instr(head, F.lit(p))
            rows.append(F.when(place > 0, F.struct(place.alias("place"), F.lit(i).alias("form"), iso.alias("iso"))))
        return F.array_min(F.array(*rows)).getField("iso")

    return let(F.substring(text, 1, 600), found)


def page_date(html: Column, text: Column) -> Column:
    """The day of "last updated on 31/12/2024" where the page says so, else the text's first date."""
    said = r"last updated on (\d{2})/(\d{2})/(\d{4})"
    day = F.concat_ws("-", *(F.regexp_extract(html, said, g) for g in (3, 2, 1)))
    return F.when(html.rlike(said), day).otherwise(first_date(text))


def norm_line(line: Column) -> Column:
    """For line repeats: runs of anything but letters, digits and underscores are one blank."""
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}_]+", " "))


def norm_text(text: Column) -> Column:
    """For duplicates of records: ASCII letters and digits only."""
    # A single blank between words is no match, as it would be replaced by itself.
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]{2,}|[^a-z0-9 ]", " "))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def let(value: Column, of) -> Column:
    """of(value), with value computed once per row: a lambda over it would compute it for each element."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def shingles(norm: Column, k: int = 3) -> Column:
    """Distinct runs of k words; a shorter text is one; none for an empty text."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.array_join(F.slice(w, i, k), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < k, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(runs))

    return let(words(norm), of)


def unigrams(norm: Column) -> Column:
    return F.array_distinct(F.filter(words(norm), lambda w: F.length(w) > 2))


def jaccard(a: Column, b: Column) -> Column:
    def of(common: Column) -> Column:
        whole = F.size(a) + F.size(b) - common
        return F.when(whole == 0, 0.0).otherwise(common / whole)

    return let(F.size(F.array_intersect(a, b)), of)


def content_hash(title: Column, content: Column) -> Column:
    return F.substring(F.sha1(F.concat(title, F.lit("\n"), content)), 1, 16)


def citation(title: Column, file: Column, locator: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("] "), file, F.when(F.coalesce(locator, F.lit("")) != "", F.concat(F.lit(", "), locator)).otherwise(""))


def tokenize(text: Column, stop=STOP_WORDS) -> Column:
    """Search terms: lower-case ASCII words, no stop words, two characters or more, plurals cut."""
    found = F.filter(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)), lambda t: (F.length(t) >= 2) & ~t.isin(list(stop)))
    return F.transform(
        found,
        lambda t: F.when((F.length(t) > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, F.length(t) - 3), F.lit("y")))
        .when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), F.substring(t, 1, F.length(t) - 1))
        .otherwise(t),
    )


def token_estimate(text: Column) -> Column:
    return F.floor(F.size(words(text)) * 1.3).cast("long")


def title_path(title: Column, headings: Column) -> Column:
    return F.array_join(F.concat(F.array(title), F.filter(headings, lambda h: (h != "") & (h != title))), " > ")


def clip(text: Column, most: int = 420) -> Column:
    """At most so many characters, cut at a blank."""
    return F.when(F.length(text) <= most, text).otherwise(F.regexp_replace(F.substring(text, 1, most), r"\s\S*\z", ""))


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Anywhere, also inside a word."""
    return reduce(lambda a, b: a | b, (F.contains(F.lower(text), F.lit(p.lower())) for p in phrases), F.lit(False))


def is_question(text: Column, first: list[str] = QUESTION, letters: str = r"\p{L}\p{N}_") -> Column:
    """Ends with a question mark or begins with one of the words, behind which none of the letters follows. These are named, as
    Java's own edge of a word is that of all scripts up to version 18 and of ASCII from 19 on."""
    return F.trim(text).endswith("?") | F.trim(text).rlike(rf"(?i)^({'|'.join(first)})(?![{letters}])")


def rounded(number: Column, places: int) -> Column:
    """Rounded as SQL engines do it that scale a double: Spark's own round() goes by its shortest decimals, so that what was rounded
    before (0.145, which is a little less) would go up."""
    return F.round(number * 10.0**places) / 10.0**places


def safe_json(text: Column, schema: str) -> Column:
    """A JSON object, also in a fenced block; null for anything else."""
    return F.from_json(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*|\s*```$", ""), schema)
