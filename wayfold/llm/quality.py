"""Text quality statistics and text types learned from noisy labelling functions.

Each statistic with a threshold is a labelling function that votes for one type or
is silent.  Many are wrong about a type of their own: short lines are no list where
a table has them.  How often every function fires for each type is unknown; it is
learned by expectation-maximization from the agreements of the functions over all
texts (counts of vote patterns, at most 2^functions whatever the corpus), and every
text gets the posterior of its type.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.runtime import bounded_rows, cut

TYPES = ("prose", "list", "table", "junk")
MOST_WORDS = 200_000
EDGE = ".,;:!?\"'()[]{}*_#>«»¿¡…“”‘’-"
LINE_END = ".!?…:;"

WORD = re.compile(r"[^ \t\n\r\f\v]+")
LINES = re.compile(r"\r\n|\r|\n")
SYMBOL = re.compile(r"[^\w \t\n\r\f\v]|_")
RUN = re.compile(r"[A-Za-z0-9]+")
ITEM = re.compile(r"\s*(?:[-*•·‣▪–—+>]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)]|\[[ xX✓]?\]|[☐☑✓✗→])\s+\S")
PAIR = re.compile(r"\s*[^\W\d_][\w /-]{0,24}(?::|=|\s->)\s*\S")
GAP = re.compile(r"\S(?: {2,}|\t)(?=\S)")
RULE = re.compile(r"^[\s|+:=-]+$")
#: Marks that may set apart the items of a list within one line.
MARKS = (" / ", " • ", "; ", " | ", " · ", " * ", " - ", " – ", " — ", " + ", " > ", ", ", " ~ ", " → ")
DAMAGE = re.compile(r"Ã|Â|â€|Ð|Ñ|ï¿½|å¤|�|[\u0080-\u009f]|\\x[0-9a-f]{2}|&#\d+;|%[0-9A-F]{2}")
#: Five consonants in a row, or four outside of the ends of words that have them by nature.
FIVE = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
FOUR = re.compile(r"[bcdfghjklmnpqrstvwxz]{4}")
NATURAL = re.compile(r"ngth|tchs|ghts|rths|rsch|ndst|cht")
#: Bytes of Latin letters by whether they are vowels or consonants, anything else as a space.
SOUND = bytes(118 if c in "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýÿ" else 99 if c in "bcdfghjklmnpqrstvwxzçñðþß" else 32 for c in (chr(i).lower() for i in range(256)))
#: Without one of these there is no damage, or no foreign letter; quicker to look for.
DAMAGE_MAYBE = re.compile(r"[ÃÂâÐÑïå�\u0080-\u009f\\&%]")
FOREIGN_MAYBE = re.compile(r"[^\u0000-ɏ]")
FOREIGN = re.compile(r"[^\W\d_\u0000-ɏ℀-⯿]")

STATS = (
    ("n_words", T.LongType()),
    ("mean_word_length", T.DoubleType()),
    ("symbol_ratio", T.DoubleType()),
    ("line_end_share", T.DoubleType()),
    ("common_share", T.DoubleType()),
)
#: name, the types it votes for, and a threshold on a statistic of :func:`describe`.
FUNCTIONS = (
    ("common_words", "prose", lambda s: s["common"] >= 0.18),
    ("long_lines", "prose", lambda s: s["per_line"] >= 9),
    ("sentences", "prose", lambda s: 3 <= s["sentence"] <= 45),
    ("clean_words", "prose", lambda s: s["wordlike"] >= 0.85),
    ("letter_flow", "prose list table", lambda s: 0.5 <= s["syllables"] < 0.85),
    ("other_script", "prose", lambda s: s["foreign"] >= 0.5),
    ("item_marks", "list", lambda s: s["items"] >= 0.55),
    ("key_value", "list", lambda s: s["pairs"] >= 0.6),
    ("short_lines", "list table", lambda s: s["lines"] >= 4 and s["per_line"] <= 7),
    ("inline_marks", "list", lambda s: s["segment"] <= 5.5),
    ("few_common", "list table junk", lambda s: s["common"] < 0.12),
    ("same_fields", "table", lambda s: s["grid"] >= 0.55),
    ("field_lines", "table", lambda s: s["fields"] >= 0.6),
    ("repetition", "junk", lambda s: s["words"] >= 8 and s["distinct"] <= 0.045),
    ("same_words", "junk", lambda s: s["words"] >= 8 and s["kinds"] <= 2),
    ("same_lines", "junk", lambda s: s["lines"] >= 4 and s["line_kinds"] <= 0.25),
    ("symbols", "junk", lambda s: s["symbol"] >= 0.45),
    ("long_runs", "junk", lambda s: s["run"] >= 13),
    ("short_runs", "junk", lambda s: 0 < s["run"] <= 2.4),
    ("damage", "junk", lambda s: s["damage"] >= 0.12),
    ("clusters", "junk", lambda s: s["clusters"] >= 0.2),
    ("no_words", "junk", lambda s: s["wordlike"] < 0.12),
    ("even_syllables", "junk", lambda s: s["syllables"] >= 0.9),
)


def fields_of(line: str) -> tuple[str, int]:
    """The mark that makes most fields of a line, and how many fields.

    Commas and semicolons part fields only where these are short, three words at most
    on average; else they are those of sentences.
    """
    best = ("", 1)
    for mark in ("\t", "|", ";", ","):
        n = line.count(mark) + 1
        if mark == "|" and n > 1:
            n -= line.lstrip().startswith("|") + line.rstrip().endswith("|")
        if n > best[1] and (mark in "\t|" or len(line.split()) <= 3 * n):
            best = (mark, n)
    gaps = len(GAP.findall(line)) + 1 if "  " in line or "\t" in line else 1
    if best[1] < 4 and gaps > best[1]:
        best = ("  ", gaps)
    return best


#: Statistics of a text without words; a sentence length of 0 stands for no sentence end.
ZEROS = dict.fromkeys(
    ("words", "length", "symbol", "ends", "common", "lines", "line_kinds", "per_line", "wordlike", "sentence", "segment", "distinct", "kinds", "grid", "fields", "items", "pairs", "run", "damage", "clusters", "foreign", "syllables"), 0.0
)


def describe(text: str, common: frozenset[str]) -> dict:
    """All statistics of one text; of an empty or blank one they are zeros."""
    words = WORD.findall(text)
    if not words:
        return dict(ZEROS)
    n, chars = len(words), sum(map(len, words))
    plain = [w.lower().strip(EDGE) for w in words]
    known = sum(map(common.__contains__, plain))
    alnum = [w for w in plain if w and (w.isalnum() or any(map(str.isalnum, w)))]
    lines = [x for x in map(str.strip, LINES.split(text)) if x]
    kinds = len(set(alnum))
    out = ZEROS | {
        "words": n,
        "length": chars / n,
        "symbol": len(SYMBOL.findall(text)) / len(text),
        "ends": sum(x[-1] in LINE_END for x in lines) / len(lines) if lines else 0.0,
        "common": known / n,
        "lines": len(lines),
        "line_kinds": len(set(lines)) / len(lines) if lines else 0.0,
        "per_line": n / len(lines) if lines else float(n),
        "distinct": kinds / len(alnum) if alnum else 0.0,
        "kinds": kinds,
        "segment": 99.0,
    }
    alpha = [w for w in alnum if w.isalpha() or w.replace("'", "").replace("’", "").replace("-", "").isalpha()]
    out["wordlike"] = sum(2 <= len(w) <= 16 or w in common for w in alpha) / n
    stops = sum(w[-1] in ".!?…" for w in words)
    if stops:
        out["sentence"] = n / stops
    runs = RUN.findall(text)
    out["run"] = sum(map(len, runs)) / len(runs) if runs else 0.0
    out["damage"] = len(DAMAGE.findall(text)) / chars if DAMAGE_MAYBE.search(text) else 0.0
    out["foreign"] = len(FOREIGN.findall(text)) / max(1, chars) if FOREIGN_MAYBE.search(text) else 0.0
    # Of the pairs of neighbouring letters those of a vowel and a consonant; few letters count as if more.
    sound = text.encode("latin-1", "replace").translate(SOUND)
    together = sound.count(b"v") + sound.count(b"c") - len(sound.split())
    out["syllables"] = (sound.count(b"vc") + sound.count(b"cv")) / max(together, chars / 4)
    if b"cccc" in sound:
        long_ = [w for w in plain if len(w) >= 5 and w.isascii() and FOUR.search(w) and not any(map(str.isdigit, w))]
        out["clusters"] = sum(NATURAL.search(w) is None or FIVE.search(w) is not None for w in long_) / n
    body = lines[1:] if len(lines) > 1 and lines[0].endswith(":") else lines
    size = sum(map(len, body)) or 1
    out["items"] = sum(len(x) for x in body if ITEM.match(x)) / size if len(body) > 1 else 0.0
    out["pairs"] = sum(len(x) for x in body if PAIR.match(x)) / size if len(body) > 1 else 0.0
    weight: dict = {}
    for x in body if len(body) > 1 else ():
        if (f := fields_of(x))[1] >= 4:
            weight[f] = weight.get(f, 0) + len(x)
    many: dict = {}
    for (mark, _), k in weight.items():
        many[mark] = many.get(mark, 0) + k
    if weight:
        spaced = many.get("  ", 0) / size
        out["grid"] = max([spaced, *(k / size for (mark, _), k in weight.items() if mark != "  ")], default=0.0)
        out["fields"] = max(many.values(), default=0) / size
        if RULE.match(body[1]) and len(body) > 2 and spaced >= 0.35:
            out["grid"] = max(out["grid"], 0.6)
    joined = " ".join(body)
    best = max(((joined.count(m) + 1) for m in MARKS), default=1)
    if best >= 4 and len(body) <= max(3, best / 3):
        out["segment"] = len(WORD.findall(joined)) / best
    return out


#: A function is never taken to be surer than this, as functions aren't independent.
UNSURE = 0.01


#: Functions thought to fire for nearly all texts of the types they vote for.
NEARLY_ALL = ("common_words", "letter_flow")


def start_rates() -> np.ndarray:
    """What is thought of the firing rates before learning: one row a type, one column a function.

    A function fires for a type it votes for in half of the cases, or in nine of ten,
    and for another in one of fifty.  Junk is of many kinds, of which a function that
    votes for nothing else knows one: a fifth of the cases.
    """

    def rate(name: str, types: str, t: str) -> float:
        if t not in types.split():
            return 0.02
        return 0.9 if name in NEARLY_ALL else 0.2 if types == "junk" else 0.5

    return np.array([[rate(n, types, t) for n, types, _ in FUNCTIONS] for t in TYPES])


def learn(patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Priors of the types and firing rates of the functions, by EM.

    ``patterns`` are 0/1 rows; ``start`` has the rates to begin with, a row a type, and
    they are kept as pseudo-counts.
    """
    k, m = start.shape
    prior, rate = np.full(k, 1 / k), start.copy()
    total = counts.sum()
    strength = 4.0
    for _ in range(rounds):
        logp = np.log(prior) + patterns @ np.log(rate).T + (1 - patterns) @ np.log(1 - rate).T
        logp -= logp.max(axis=1, keepdims=True)
        post = np.exp(logp)
        post /= post.sum(axis=1, keepdims=True)
        w = post * counts[:, None]
        new_prior = (w.sum(axis=0) + 1) / (total + k)
        new_rate = (w.T @ patterns + strength * start) / (w.sum(axis=0)[:, None] + strength)
        new_rate = np.clip(new_rate, UNSURE, 1 - UNSURE)
        moved = max(np.abs(new_rate - rate).max(), np.abs(new_prior - prior).max())
        prior, rate = new_prior, new_rate
        if moved < 1e-7:
            break
    assert rate.shape == (k, m)
    return prior, rate


def statistics(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the five statistics and the votes (a bit mask) of every row of ``documents``.

    A word is a run without white space; the share of common words compares words
    in lower case without punctuation at their ends with the words of any language.
    Null texts have null statistics, empty and blank ones zeros, both no votes.
    Repeated rows stay repeated.  Other columns, whatever their names, aren't read.
    """
    words = frozenset(r[0].lower() for r in bounded_rows(common_words.select("word").where("word is not null"), MOST_WORDS, "common words"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t in b["t"]:
                if t is None:
                    rows.append((None, None, None, None, None, None))
                    continue
                s = describe(t, words)
                mask = sum(1 << i for i, (_, _, f) in enumerate(FUNCTIONS) if f(s)) if s["words"] else None
                rows.append((s["words"], s["length"], s["symbol"], s["ends"], s["common"], mask))
            made = pd.DataFrame(rows, columns=[*(n for n, _ in STATS), "votes"], index=b.index)
            made.insert(0, "k", b["k"])
            for c in ("n_words", "votes"):
                made[c] = made[c].astype("Int64")
            yield made

    schema = T.StructType([T.StructField("k", documents.schema[key].dataType), *(T.StructField(n, t) for n, t in STATS), T.StructField("votes", T.LongType())])
    return documents.select(documents[key].alias("k"), documents[text].alias("t")).mapInPandas(run, schema).withColumnRenamed("k", key)


def text_types(documents: DataFrame, common_words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The statistics of every row with ``p_prose`` ... ``p_junk`` and the ``kind``.

    kind is 'prose' where its posterior is at least half, else the likeliest other
    type; null, with null posteriors, for null, empty and blank texts.  An empty
    table gives an empty one.
    """
    stats = cut(statistics(documents, common_words, key, text))
    seen = stats.where("votes is not null").groupBy("votes").count().collect()  # at most one for each vote pattern, 2^len(FUNCTIONS)
    m = len(FUNCTIONS)
    if seen:
        patterns = np.array([[r["votes"] >> i & 1 for i in range(m)] for r in seen], float)
        prior, rate = learn(patterns, np.array([r["count"] for r in seen], float), start_rates())
    else:
        prior, rate = np.full(len(TYPES), 1 / len(TYPES)), np.full((len(TYPES), m), 0.5)
    made = []
    for r in seen:
        on = np.array([r["votes"] >> i & 1 for i in range(m)], float)
        logp = np.log(prior) + on @ np.log(rate).T + (1 - on) @ np.log(1 - rate).T
        post = np.exp(logp - logp.max())
        post = (post / post.sum()).tolist()
        kind = TYPES[0] if post[0] >= 0.5 else TYPES[1 + int(np.argmax(post[1:]))]
        made.append((r["votes"], *post, kind))
    names = [f"p_{t}" for t in TYPES]
    types = stats.sparkSession.createDataFrame(made, f"v bigint, {', '.join(f'{n} double' for n in names)}, kind string")
    out = stats.join(types, F.col("votes") == F.col("v"), "left")
    return out.select(key, *(n for n, _ in STATS), "votes", *names, "kind")
