"""Regular expressions and word lists whose values decide the results.

Everything in this module is a fixed value: word lists, lookup tables,
thresholds and patterns are stated plainly and are not derived.
"""

from __future__ import annotations

# Fixed value: the characters Python treats as white space when stripping.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# One white-space character, one word character and a word boundary, spelled
# out so that they mean the same on every Java version.
_SPACES = r"\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACE = rf"[{_SPACES}]"
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"

# Extraction patterns. A look-ahead for the first character stands
# before the boundary test where it spares the dearer look-behind.
PRICE = rf"[$£€¥₹]{SPACE}*[\d,]+\.?\d*"
PERCENTAGE = rf"\d+\.?\d*{SPACE}*%"
PLAIN_NUMBER = rf"(?=\d)(?<!{WORD})\d+\.?\d*{EDGE}"
EMAIL = rf"(?=[A-Za-z0-9._%+-]){EDGE}[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{{2,}}{EDGE}"
URL = rf"https?://[^{_SPACES}<>\"{{}}|\\^`\[\]]+"
PHONE = (
    rf"(?=[+(0-9]){EDGE}[+]?[(]?[0-9]{{3}}[)]?[-.{_SPACES}]?[0-9]{{3}}[-.{_SPACES}]?[0-9]{{4,6}}{EDGE}"
)
_NUMERIC_DATE = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{4}[-/]\d{1,2}[-/]\d{1,2}"
DATE_ANY_MONTH = (
    rf"(?i)(?=[\dJFMASOND])(?<!{WORD})(?:{_NUMERIC_DATE}|"
    rf"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    rf"[a-z]*\.?{SPACE}+\d{{1,2}},?{SPACE}+\d{{4}}){EDGE}"
)
DATE_FULL_MONTH = (
    rf"(?=[\dJFMASOND])(?<!{WORD})(?:{_NUMERIC_DATE}|"
    rf"(?:January|February|March|April|May|June|July|August|"
    rf"September|October|November|December){SPACE}+\d{{1,2}},?{SPACE}+\d{{4}}){EDGE}"
)
PROPER_NOUN = rf"(?=[A-Z])(?<!{WORD})[A-Z][a-z]+(?:{SPACE}+[A-Z][a-z]+)+{EDGE}"
# The label holds no colon, so it can be read without giving characters back.
LABELLED_NUMBER = (
    rf"[A-Za-z][A-Za-z{_SPACES}]{{2,20}}+:{SPACE}*"
    rf"[£$€₹¥]?{SPACE}*[\d,.]+{SPACE}*(?:billion|million|trillion|%)?"
)
# What a text must hold for one of the dearer patterns to match at all.
DATE_HINT = r"\d[-/]\d{1,2}[-/]\d|\d{4}"
PHONE_HINT = r"[0-9]{3}"
LABEL_HINT = rf":{SPACE}*[£$€₹¥]?{SPACE}*[\d,.]"
SENTENCE_BREAK = rf"(?<=[.!?]){SPACE}+"
PARAGRAPH_BREAK = r"\n\n+"

# Fixed value: common English words left out of keyword counts.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for",
    "of", "with", "by", "from", "is", "are", "was", "were", "be", "been",
    "has", "have", "had", "do", "does", "did", "will", "would", "could",
    "should", "may", "might", "this", "that", "these", "those", "it", "its",
    "we", "you", "he", "she", "they", "i", "my", "your", "our", "their",
    "what", "which", "who", "when", "where", "how", "not", "no", "as", "if",
    "so", "than", "then", "more", "also", "about", "up", "out", "into",
    "can", "all", "one", "some", "any", "each", "s", "t", "re", "ll", "ve",
]

# Fixed value: topics in tie order, each with its keywords.
TOPIC_KEYWORDS = {
    "Technology": ["software", "app", "data", "ai", "machine learning", "python", "cloud", "api",
                   "developer", "code", "digital", "tech", "internet"],
    "Finance": ["price", "cost", "revenue", "profit", "market", "stock", "investment", "financial",
                "economy", "budget", "tax", "bank", "money"],
    "Health": ["health", "medical", "doctor", "treatment", "disease", "patient", "hospital",
               "medicine", "therapy", "wellness", "diet", "fitness"],
    "E-Commerce": ["product", "buy", "sell", "shop", "cart", "checkout", "order", "delivery",
                   "shipping", "discount", "review", "rating"],
    "News": ["report", "government", "policy", "election", "president", "minister", "parliament",
             "law", "court", "crime", "international"],
    "Education": ["learn", "course", "student", "university", "school", "training", "education",
                  "skill", "certificate", "degree", "teacher"],
    "Travel": ["hotel", "flight", "destination", "travel", "trip", "tour", "booking", "vacation",
               "resort", "airport", "visa"],
}

# Fixed value: sentiment label limits on polarity.
STRONG_POLARITY = 0.5
WEAK_POLARITY = 0.1

# Fixed value: object keys under which a response may wrap its record list, by priority.
WRAPPER_KEYS = [
    "data", "records", "results", "items", "extracted_data", "products", "articles", "jobs",
    "events", "listings", "entries", "coins", "companies", "quotes",
]

# Domain suffixes and script fingerprints of pages that need a browser.
DYNAMIC_DOMAINS = [
    "twitter.com", "x.com", "instagram.com", "facebook.com", "linkedin.com", "youtube.com",
    "tiktok.com", "reddit.com", "airbnb.com", "booking.com", "zillow.com",
]
STATIC_DOMAINS = [
    "wikipedia.org", "en.wikipedia.org", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com",
    "github.com", "stackoverflow.com", "docs.python.org",
]
SCRIPT_FINGERPRINTS = [
    r"__NEXT_DATA__", r"react(?:dom)?[\./]", r"_reactFiber", r"data-reactroot",
    r"vue(?:\.min)?\.js", r"__vue_", r"ng-version", r"angular(?:\.min)?\.js",
    r"<div[^>]+id=['\"]app['\"]", r"<div[^>]+id=['\"]root['\"]", r"<div[^>]+id=['\"]main['\"]",
    r"window\.__STORE__", r"window\.__INITIAL_STATE__", r"window\.__PRELOADED_STATE__",
]

# Fixed value: column-name patterns of semantic types, first match wins.
SEMANTIC_NAMES = [
    ("price", r"price|cost|fee|amount|salary|wage"),
    ("rating", r"rating|score|stars|grade|rank"),
    ("date", r"date|time|posted|created|updated|published"),
    ("url", r"url|link|href|website"),
    ("count", r"count|number|qty|quantity|total|num_"),
    ("text", r"name|title|label|description|summary"),
]

# Fixed value: fields tried, in order, when no record key is named.
KEY_FIELDS = ["name", "symbol", "title", "company", "id", "rank"]
