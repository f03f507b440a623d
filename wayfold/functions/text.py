"""Text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is redacted, in this order, and what is refused, first match first.
PII = {
    "ssn": r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b",
    "bank_account": r"\b\d{8,17}\b",
    "phone": r"\b(?:\+1[-\s]?)?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
}
REFUSED = (
    ("pii", r"\b(ssn|social\s*security(\s+number)?)\b"),
    ("financial", r"\b(credit\s*card|bank\s*account|routing\s*number)\b"),
    ("credentials", r"\b(password|api[_\s]?key|auth[_\s]?token|secret[_\s]?key)\b"),
    ("offtopic", r"^(what('?s| is) the weather|write (me )?a (poem|story|joke)|tell (me )?a joke)\b"),
)
PUNCTUATION = r"""[.,;:!?'"()\[\]{}]"""


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edits / longer length; both empty 1, one empty 0."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def soundex_code(text: Column) -> Column:
    """Soundex in which vowels don't part equal codes; without letters 0000."""
    s = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    first = F.substring(s, 1, 1)
    coded = F.translate(F.regexp_replace(s, "[AEIOUHWY]", ""), "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    lead = F.translate(first, "BFPVCGJKQSXZDTLMNR", "111122222222334556")
    own = F.when(first.rlike("[AEIOUHWY]"), F.lit("")).otherwise(lead)
    rest = F.when(first.rlike("[AEIOUHWY]"), coded).otherwise(F.substring(coded, 2, 1_000_000))
    once = rest
    for d in "123456":
        once = F.regexp_replace(once, f"{d}+", d)
    once = F.when((own != "") & F.startswith(once, own), F.substring(once, 2, 1_000_000)).otherwise(once)
    return F.when(s == "", "0000").otherwise(F.substring(F.concat(first, once, F.lit("000")), 1, 4))


# Rewrites of the sound code, in this order.
SOUNDS = (
    ("^KN", "N"), ("^GN", "N"), ("^PN", "N"), ("^AE", "E"), ("^WR", "R"), ("^WH", "W"), ("MB$", "M"), ("PH", "F"),
    ("TCH", "CH"), ("GH", ""), ("GN", "N"), ("KN", "N"), ("CK", "K"), ("SCH", "SK"), ("SH", "X"), ("TH", "0"),
    ("DG", "J"), ("C(?=[IEY])", "S"), ("C", "K"), ("Q", "K"), ("X", "KS"), ("Z", "S"), ("[AEIOU]", ""),
)


def sound_code(text: Column) -> Column:
    """A short code of how a word sounds: rewrites, a leading vowel kept, repeats once, six letters."""
    s = F.regexp_replace(F.upper(text), "[^A-Z]", "")
    lead = F.when(s.rlike("^[AEIOU]"), F.substring(s, 1, 1)).otherwise(F.lit(""))
    out = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), SOUNDS, s)
    return F.substring(F.regexp_replace(F.concat(lead, out), r"(.)\1+", "$1"), 1, 6)


def content_hash(text: Column, strip_punctuation: bool = False) -> Column:
    """First 16 hex digits of the SHA-256 of the lower-case, space-collapsed text."""
    t = F.trim(F.regexp_replace(F.lower(text), r"[ \t\r\n\f\x0b]+", " "))
    if strip_punctuation:
        t = F.regexp_replace(t, PUNCTUATION, "")
    return F.substring(F.sha2(t, 256), 1, 16)


def redact(text: Column) -> tuple[Column, dict[str, Column]]:
    """The redacted text, and how many of each kind were found on the way."""
    counts = {}
    for name, pattern in PII.items():
        counts[name] = F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, f"[REDACTED-{name.upper()}]")
    return text, counts


def refusal(text: Column) -> Column:
    """The first rule a query breaks; null if none."""
    return reduce(lambda w, r: w.when(text.rlike(f"(?i){r[1]}"), r[0]), REFUSED[1:], F.when(text.rlike(f"(?i){REFUSED[0][1]}"), REFUSED[0][0]))


def highlight(text: Column, terms: list[str]) -> Column:
    """Terms wrapped in <mark>."""
    return F.regexp_replace(text, rf"(?i)\b({'|'.join(terms)})\b", "<mark>$1</mark>")


def sanitize(text: Column, most: int = 500) -> Column:
    """Cut to a length, without control characters, spaces collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring(text, 1, most), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"[ \t\r\n]+", " "))


def words(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != ""))


def overlap(text: Column, query: str) -> Column:
    """Share of the distinct query words that the text holds."""
    q = sorted({w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split()})
    low = F.lower(text)
    held = (F.when(low.contains(w) & low.rlike(rf"(?<![a-z0-9]){w}(?![a-z0-9])"), 1).otherwise(0) for w in q)
    return F.when(text.isNotNull(), sum(held, F.lit(0)) / F.lit(float(max(1, len(q)))))
