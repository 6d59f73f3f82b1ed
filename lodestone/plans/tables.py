"""Rule tables of the queries over the driver's data, whose prose is invented: words and patterns that occur in it."""

from __future__ import annotations

#: Terminology rewrites, in order.
REWRITES = [(r" [Tt]he ", " the "), (r" the of ", " of the "), (r" of the ", " of that "), (r" der die ", " die der "), (r"([0-9]) %", "$1%"), (r"token =", "token:")]
#: Categories and their keywords, lower case.
CATEGORIES = {"ing": ["thing", "ring"], "tion": ["tion", "ation"], "heit": ["heit", "keit"], "ment": ["ment", "eaux"], "cion": ["ción", "mente"], "mail": ["@"]}
INTENTS = {"ing": ["product"], "tion": ["product", "faq"], "heit": ["qualification"], "ment": ["objection"], "cion": ["compliance"], "mail": ["faq"]}
#: Flags of a text.
FLAGS = {"has_secret": r"(?i)(?:token|key|secret)\s*=", "has_license": r"(?i)licen[cs]e", "has_table": r"\|", "has_mail": r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"}
#: Facts: pattern and number of groups.
FACTS = {"secret": (r"(?i)(token|key|secret)\s*=\s*\"([0-9a-f]{4})", 2), "phone": (r"\+1 \((\d{3})\) ([0-9]{3})-", 2)}
#: Live rules: speaker, kind, confidence, pattern. Words stand between white space, as engines differ in what a word's edge is.
_WORD = r"(?i)(?:\A|\s)(?:%s)(?:\s|\z)"
LIVE = [
    ("customer", "buying_signal", 0.78, _WORD % "and|und|et"),
    ("customer", "rising_frustration", 0.88, _WORD % "(?:the|der|les) (?:of|die|un)"),
    ("customer", "callback_need", 0.60, _WORD % "with|von|dans"),
    ("agent", "compliance_gap", 0.93, _WORD % "thing|nicht|pour"),
]
DISCLOSED = _WORD % "this|sich|avec"
#: What is said before a call, by its number: (speaker, text) in turn, and the kinds of nudge that this should give.
SCRIPTS = [
    ([("agent", "Good day, this call is being recorded."), ("customer", "It is for me alone."), ("customer", "There is a second car in the family, too.")], ["missed_cross_sell"]),
    ([("agent", "Good day, approval is guaranteed with us, no exclusions and no questions asked, today and any other day of the year, as long as you like and as we have always said to all who asked."), ("customer", "Is that so?"), ("agent", "It is.")], ["compliance_gap"]),
    ([("agent", "Good day, this call is being recorded."), ("customer", "I am 42 years old."), ("agent", "How old are you?"), ("customer", "This is ridiculous.")], ["rising_frustration"]),
    ([("agent", "Good day, this call is being recorded."), ("customer", "hm, well, one moment"), ("customer", "perhaps next year")], []),
    ([("agent", "Selamat siang, panggilan ini direkam."), ("customer", "Mahal banget, gaji belum ada."), ("customer", "Today is not a good time."), ("customer", "And it is too expensive, mahal banget.")], ["callback_need", "payment_difficulty"]),
]
_M = "'January,February,March,April,May,June,July,August,September,October,November,December'"


def dated(n: str) -> str:
    """SQL of both engines: a date in one of six forms, or none, by the number n."""
    text = lambda x: f"CAST({x} AS STRING)"
    day, month, year = f"({n} % 28 + 1)", f"({n} % 12 + 1)", text(f"(2000 + {n} % 25)")
    name, two = f"split_part({_M}, ',', CAST({month} AS INT))", lambda x: f"lpad({text(x)}, 2, '0')"
    forms = [f"{year}, '-', {two(month)}, '-', {two(day)}", f"{text(day)}, '/', {text(month)}, '/', {year}", f"{two(day)}, '-', substr({name}, 1, 3), '-', {year}", f"{name}, ' ', {text(day)}, ', ', {year}", f"{text(day)}, ' ', {name}, ' ', {year}", f"{name}, ' ', {year}"]
    return f"CASE {n} % 7 " + " ".join(f"WHEN {i} THEN concat({x})" for i, x in enumerate(forms)) + " ELSE 'Smarch 12, 2020' END"


#: A text with two dates before it, and a page with the day of its last update, by number.
DATED_TEXT = f"concat('Notes of ', {dated('doc_id')}, ', seen ', {dated('(doc_id * 3 + 1)')}, '. ', text)"
DATED_PAGE = f"concat('<p>', {dated('page_id')}, '</p>', html, CASE WHEN page_id % 3 = 0 THEN concat('last updated on ', lpad(CAST(page_id % 28 + 1 AS STRING), 2, '0'), '/07/2021') ELSE '' END)"
#: Terms in their many forms, put before a text by its number.
PHRASES = [
    "Cash-less hospitalization upto Rs. 5 lacs, 3 lac more for 10 % of members", "copayments, co payments and a co-pay; PEDs or pre existing conditions of 2 yrs", "TAT of the PPME and u/s 80D; hospitalized on 3/4/2024",
    "ACME PLUS with no claim bonus, life-time renewability, health check ups on Mar 7, 2024", "sum assured of Rs 2,50,000 L on 21st March 2024", "upto 1 yr, dial 1800-022-055 or 1234-012-34 on 45/3/2024, 12-Smarch-2020 or 7-dec-2021",
]
PHRASED = "concat(CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES)) + " END, ' ', text)"
PLANS = ["Acme Plus"]
#: Lines that the rules of cleaning, flags, facts, categories and kinds of cover ask for, put before a text by its number.
NOTES = [
    "We use cookies to make this page better", "All Rights Reserved by the owners of this page", "Copyright 2024 of the owners", "Customer Login", "Privacy Policy | Imprint",
    "Limited period offer: annual premium excl gst: 0 for the floater plan", "Internal only: 30 days of waiting period, TBD", "-----", "(Superseded by the newer edition, retained for reference)",
    "call window.dataLayer.push here", "window.datalayer is another name for it", "Essential plans: entry age 18 to 60, family shield too; about 8,900+ network hospitals",
    "The essential cover has an entry age 18-65; about 9,500 network hospitals. Rate pending approval", "Claims take an average of 7 working days; 1.2 million members; critical illness and OPD",
    "Claims take an average of 10 working days; 1.2 million members; hospital cash, senior care", "THIS LINE IS OUTDATED: co-payment waiver and credit life, legacy text?", "Annual premium for zone A: 0, paid monthly; objection and approved response",
]
NOTED = "concat(CASE doc_id % 17 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(NOTES)) + " END, CAST(chr(10) AS STRING), text)"
#: The file that a record is said to come from, by its number.
FILE = "concat(CASE doc_id % 5 WHEN 0 THEN 'underwriting_rules' WHEN 1 THEN 'faq' WHEN 2 THEN 'brochure_2023' WHEN 3 THEN 'policy_wording' ELSE source END, '.md')"
#: Questions, by number: each asks in a way that a rule of the search is for, behind the first words of an item.
QUESTIONS = ["What does the essential plan cost for kids?", "Is a critical illness of my parents covered?", "copay upto 2 lacs", "Who is the CEO, and what is the share price?", "family floater with maternity", "how do I cancel", "old age cover", ""]
QUESTION = "concat(CASE item_id % 8 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(QUESTIONS)) + " END, CASE WHEN item_id % 8 IN (0, 7) THEN '' ELSE concat(' ', split_part(text, ' ', 1), ' ', split_part(text, ' ', 2), ' ', split_part(text, ' ', 3), ' ', split_part(text, ' ', 4)) END)"
#: What the questions ask for, and the fields of the records, by number.
WANTED = {
    "market": "CASE item_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'xx' END",
    "category": "CASE WHEN item_id % 7 = 1 THEN 'c1' END",
    "intent": "CASE WHEN item_id % 7 = 2 THEN 'faq' END",
    "product": "CASE WHEN item_id % 7 = 3 THEN 'essential' END",
}
EXCLUDED = "item_id % 7 = 4"
KIND = "concat('c', CAST(doc_id % 6 AS STRING))"
#: What customers say, by call and turn, before their own words; and their market.
SAID = ["My name is Ann Lee", "I am 45 years old", "I live in Navi Mumbai city", "cover for my wife and two kids, please", "no health issue", "how much is it, is it too expensive?", "call me back on Monday", "diabetes? I was born in 1950, age 40, and want 25 lakh", "stop calling, jangan telepon", "connect me to a human", "waiting for cancer or bp, my age is 70", ""]
_SPOKEN = "CASE (conv_id * 5 + turn * 7) % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(SAID)) + " END"
SPOKEN = f"CASE WHEN (conv_id * 5 + turn * 7) % 12 = 11 THEN ' ' ELSE concat({_SPOKEN}, CASE WHEN (conv_id * 5 + turn * 7) % 12 = 5 THEN '' ELSE concat('. ', substr(coalesce(text, ''), 1, 40)) END) END"
MARKET = "CASE conv_id % 4 WHEN 0 THEN 'PH' WHEN 1 THEN 'ID' ELSE 'IN' END"
TIER = "CASE (conv_id + turn) % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END"
