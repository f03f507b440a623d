"""Mapping freely typed places to a list of canonical ones.

A multi-pattern automaton over the canonical names and their aliases finds mentions
embedded in the typed text; of overlapping ones the longest wins.  What has no
mention goes to token-set similarity with the names that share letter pairs.  Among
the entries of a name the typed zip and state decide.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

from wayfold.runtime import bounded_rows

#: Most entries the list may have; each worker holds it.
MOST_ENTRIES = 200_000
#: Least similarity of the telling words of a name.
LEAST = 0.7

# Other forms of words in place names.
ALIASES = {
    "saint": ("st", "snt"), "mount": ("mt", "mnt"), "fort": ("ft",), "heights": ("hts", "hgts", "hghts", "hights"),
    "junction": ("jct", "jctn", "junc"), "springs": ("spgs", "spr", "sprgs", "spg"), "falls": ("fls",), "park": ("pk",),
    "beach": ("bch",), "lake": ("lk",), "north": ("n", "no"), "south": ("s", "so"), "east": ("e",), "west": ("w",),
    "new": ("nw",), "grand": ("gr", "grd"), "port": ("pt", "prt"), "creek": ("crk", "ck"), "city": ("cty",),
    "san": ("sn",), "santa": ("sta",), "villa": ("vl", "va", "vla"),
}
FULL = {a: w for w, many in ALIASES.items() for a in many}
# What people type where there is nothing to type.
NOTHING = {"", "na", "n a", "none", "null", "nil", "unknown", "unk", "tbd", "test", "x", "xx", "xxx", "xxxx", "xxxxx", "same", "same as billing", "see above", "not provided", "not known", "not available", "city", "town", "missing", "pending", "to follow", "asdf", "various", "other", "blank", "no city"}
# Words around a name that say nothing about it.
AROUND = {"city", "town", "of", "limits", "village", "township", "county", "near", "the", "usa", "us", "area", "municipality", "borough", "in", "greater", "metro", "vicinity"}
VOWELS = re.compile(r"[aeiouy]")
WORDS = re.compile(r"[a-z0-9]+")


def plain(text: str | None) -> str:
    """Lower-case letters and digits, without marks, single spaces."""
    text = (text or "").lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(WORDS.findall(text))


def clean_zip(text: str | None) -> str:
    """Five digits, or three as a prefix, or nothing."""
    t = re.sub(r"\s+", "", (text or "").lower())
    t = re.sub(r"\.0+$", "", t)
    if not re.search(r"\d", t):
        return ""
    t = t.replace("o", "0").replace("l", "1").replace("i", "1")
    digits = re.sub(r"\D", "", t.split("-")[0] if "-" in t else t)
    if len(digits) in (8, 9):
        digits = digits.zfill(9)[:5]
    if len(digits) == 4:
        digits = "0" + digits
    return digits if len(digits) in (3, 5) else ""


def edits(a: str, b: str, most: int = 99) -> int:
    """Edits of single letters and swaps of neighbours, each stretch edited once; most + 1 if there are more.

    A column of the table of distances is kept as bits of its steps up and down, so
    that a letter costs a few operations on whole integers.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    x, y = letter_set(a), letter_set(b)
    if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:  # a letter the other hasn't costs an edit
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    up, down, flat, before, n = full, 0, 0, 0, len(a)
    for c in b:
        here = at.get(c, 0)
        swap = ((~flat & here) << 1) & before
        flat = (((here & up) + up) ^ up | here | down | swap) & full
        plus, minus = down | (full & ~(flat | up)), flat & up
        n += (plus & top != 0) - (minus & top != 0)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(flat | plus)) & full, plus & flat
        before = here
    return min(n, most + 1)


@lru_cache(1 << 16)
def letter_set(word: str) -> int:
    """The letters of a word as bits; others may share one."""
    out = 0
    for c in word:
        out |= 1 << (ord(c) & 63)
    return out


@lru_cache(1 << 17)
def alike(a: str, b: str, least: float = 0.0) -> float:
    """Similarity of two words; left-out vowels count little.  Below ``least`` it may be too low."""
    if a == b:
        return 1.0
    long_ = max(len(a), len(b))
    if len(a) < 3 or len(b) < 3:
        return 0.0
    score = 1 - edits(a, b, min(max(2, long_ // 2), int((1 - least) * long_ + 1e-9))) / long_
    if score < 0.86 and a[0] == b[0]:
        x, y = bare(a), bare(b)
        if len(x) >= 3:
            if x == y:
                score = 0.86
            elif score < 0.74 and len(y) >= 4 and len(a) < len(b) and edits(x, y, 1) == 1:  # a vowel-less word with one more slip
                score = 0.74
    return max(0.0, score)


@lru_cache(1 << 16)
def bare(word: str) -> str:
    return VOWELS.sub("", word)


def pairs(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 2] for i in range(len(w) - 1)} | {"~" + w[i] + w[i + 2] for i in range(len(w) - 2)}


class Gazetteer:
    """The canonical places, ready for look-ups."""

    def __init__(self, entries: list[tuple]):
        # (id, city, state, state name, zip low, zip high)
        self.entries = [e for e in entries if e[0] is not None and plain(e[1])]
        self.by_name: dict[str, list[tuple]] = defaultdict(list)
        for e in self.entries:
            self.by_name[self.full(plain(e[1]))].append(e)
        count: dict[str, set[str]] = defaultdict(set)
        for n in self.by_name:
            for w in n.split():
                count[w].add(n)
        self.common = {w for w, names in count.items() if len(names) >= 4} & (set(ALIASES) | AROUND) | set(ALIASES)
        self.words: dict[str, set[str]] = defaultdict(set)  # telling word -> names
        for n in self.by_name:
            for w in self.telling(n):
                self.words[w].add(n)
        self.postings: dict[str, list[str]] = defaultdict(list)
        for w in self.words:
            for p in pairs(w):
                self.postings[p].append(w)
        self.states: dict[str, str] = {}
        for e in self.entries:
            if e[2]:
                self.states[e[2].lower()] = e[2]
                if e[3]:
                    self.states[plain(e[3])] = e[2]
        self.by_state: dict[str, set[str]] = defaultdict(set)
        for n, es in self.by_name.items():
            for e in es:
                self.by_state[e[2]].add(n)
        # Zip ranges under each three digits they touch.
        self.zips: dict[str, list[tuple]] = defaultdict(list)
        for e in sorted((e for e in self.entries if e[4] and e[5]), key=lambda e: (e[4], e[5])):
            if e[4][:3].isdecimal() and e[5][:3].isdecimal():
                for k in range(int(e[4][:3]), int(e[5][:3]) + 1):
                    self.zips[f"{k:03}"].append(e)
        self.machine = ahocorasick.Automaton()
        for n in self.by_name:
            for a in self.forms(n):
                self.machine.add_word(f" {a} ", n)
        if len(self.machine):
            self.machine.make_automaton()
        self.seen: dict[tuple, tuple] = {}
        self.near_common = lru_cache(1 << 16)(self._near_common)
        self.state = lru_cache(1 << 16)(self._state)
        self.name_forms = {n: self.forms(n) for n in self.by_name}

    @staticmethod
    def full(name: str) -> str:
        return " ".join(FULL.get(w, w) for w in name.split())

    def forms(self, name: str) -> set[str]:
        """The name and its aliases: known short words, left-out spaces."""
        out = {""}
        for w in name.split():
            out = {f"{o} {a}".strip() for o in out for a in (w, *ALIASES.get(w, ()))}
        return out | {name.replace(" ", "")}

    def telling(self, name: str) -> list[str]:
        words = name.split()
        return [w for w in words if w not in self.common] or words

    def _near_common(self, word: str) -> bool:
        """Whether a word may be a slip of a word that is common in names."""
        return any(alike(word, c) >= 0.75 if len(c) > 3 else len(c) == len(word) == 3 and edits(word, c, 1) < 2 for c in self.common)

    def mentions(self, text: str) -> tuple[list[str], list[str]]:
        """Longest non-overlapping mentions, and the words outside of them."""
        padded = f" {text} "
        hits = []
        if len(self.machine):
            for end, name in self.machine.iter(padded):
                hits.append((end, name))
        spans = []
        for end, name in hits:
            for form in self.name_forms[name]:
                if padded.endswith(f" {form} ", 0, end + 1):
                    spans.append((end - len(form) - 1, end, name))
        spans.sort(key=lambda s: (s[0] - s[1], s[0]))
        taken: list[tuple] = []
        for s in spans:
            if all(s[1] <= t[0] + 1 or s[0] >= t[1] - 1 for t in taken):
                taken.append(s)
        rest = list(padded)
        for a, b, _ in taken:
            rest[a + 1 : b] = " " * (b - a - 1)
        return [n for _, _, n in sorted(taken)], "".join(rest).split()

    def _state(self, text: str | None) -> str | None:
        t = plain(text)
        if not t or t in NOTHING:
            return None
        if t in self.states:
            return self.states[t]
        if (s := t.replace(" ", "")) in self.states:
            return self.states[s]
        short = {v for k, v in self.states.items() if len(t) >= 3 and len(k) > 2 and k.startswith(t)}
        if len(short) == 1:
            return short.pop()
        near = {v for k, v in self.states.items() if len(k) > 3 and len(t) > 3 and edits(t, k, 2) <= (2 if len(k) > 6 else 1)}
        return near.pop() if len(near) == 1 else None

    def state_choices(self, text: str | None) -> set[str]:
        """All states a cut-off name may mean ('New .', 'Nort.')."""
        one = self.state(text)
        if one:
            return {one}
        t = plain(text)
        return {v for k, v in self.states.items() if len(t) >= 3 and len(k) > 2 and k.startswith(t)}

    def at_zip(self, zip_: str) -> list[tuple]:
        """Entries with a range around a zip of five digits, or that has zips of these first three."""
        there = self.zips.get(zip_[:3], [])
        return [e for e in there if e[4] <= zip_ <= e[5]] if len(zip_) == 5 else there

    def similar(self, words: list[str]) -> list[tuple[float, str]]:
        """Names by token-set similarity to the words; telling words must be alike."""
        telling = [w for w in words if w not in self.common and not self.near_common(w)] or words
        if not telling:
            return []
        best: dict[str, float] = {}
        like: dict[str, dict[str, float]] = {}
        for w in telling:
            own = pairs(w)
            shared: dict[str, int] = defaultdict(int)
            for p in own:
                for v in self.postings.get(p, ()):
                    shared[v] += 1
            like[w] = {v: s for v, k in shared.items() if k * 6 >= len(own) and (s := alike(w, v, LEAST)) >= LEAST}
        names = {n for found in like.values() for v in found for n in self.words[v]}
        joined = "".join(words)
        if len(telling) > 1 or len(words) > 1:
            for v in {x for w in (joined, "".join(telling)) for p in pairs(w) for x in self.postings.get(p, ())}:
                if alike("".join(telling), v, 0.8) >= 0.8:
                    names |= self.words[v]
        for n in names:
            theirs = n.split()
            told = self.telling(n)
            if "".join(telling) != "".join(told) and alike("".join(telling), "".join(told)) < 0.8:
                if any(max((like[w].get(v, 0.0) for v in told), default=0.0) < LEAST for w in telling):
                    continue
                if any(max((like[w].get(v, 0.0) for w in telling), default=0.0) < LEAST for v in told):
                    continue
            score = sum(len(w) * max(alike(w, v) for v in theirs) for w in words) + sum(len(v) * max(alike(w, v) for w in words) for v in theirs)
            score /= sum(map(len, words)) + sum(map(len, theirs))
            best[n] = max(score, alike(joined, n.replace(" ", "")))
        return sorted(((s, n) for n, s in best.items() if s >= LEAST), reverse=True)

    def choose(self, names: list[tuple[float, str]], states: set[str], zip_: str) -> tuple[float, tuple] | None:
        """The entry best supported: by its name, then its zip, then its state."""
        if not names:
            return None
        top = names[0][0]
        there = {e[0] for e in self.at_zip(zip_)}
        options = [(s + 0.12 * (e[0] in there) * (1 if len(zip_) == 5 else 0.5) + 0.08 * (e[2] in states), s, e) for s, n in names if s >= top - 0.2 for e in self.by_name[n]]
        # A faint likeness needs the state or zip on its side.
        firm = 0.78 if not states and not zip_ else 0.85
        options = [o for o in options if o[1] >= firm or o[0] > o[1]]
        if not options:
            return None
        options.sort(key=lambda o: (-o[0], o[2][0]))
        return options[0][1], options[0][2]

    def find(self, city: str | None, state: str | None, zip_: str | None) -> tuple[int, str, float]:
        """(entry id or -1, how, score) of typed values."""
        key = (city, state, zip_)
        if key not in self.seen:
            if len(self.seen) > 500_000:
                self.seen.clear()
            self.seen[key] = self._find(city, state, zip_)
        return self.seen[key]

    def _find(self, city: str | None, state: str | None, zip_: str | None) -> tuple[int, str, float]:
        typed, z = plain(city), clean_zip(zip_)
        states = self.state_choices(state)
        other = plain(state)
        if typed in NOTHING or not re.search(r"[a-z]", typed):
            typed = ""
        if not states and other and other not in NOTHING and (not typed or typed in self.states):
            states, typed = self.state_choices(typed) if typed else set(), other  # swapped fields
        digits = re.findall(r"\d[\dol]{4}", typed)
        if digits:
            z = z or clean_zip(digits[-1])
        typed = " ".join(w for w in typed.split() if not re.search(r"\d", w) or re.search(r"[a-z]{2}", w))
        letters = typed.replace("0", "o").replace("1", "l")
        names, rest = self.mentions(letters)
        inside = {self.states[w] for w in rest if w in self.states} if names else set()
        if names:
            extra = [w for w in rest if w not in AROUND and w not in self.states and not w.isdigit() and w not in " ".join(self.states).split()]
            if not extra:
                got = self.choose([(1.0, n) for n in names], states or inside, z)
                return got[1][0], "mention", 1.0
        words = [w for w in self.full(letters).split() if w not in AROUND or w == "city"]
        words = [w for w in words if w != "city"]
        while len(words) > 1 and (words[-1] in self.states or words[-1].isdigit()):
            inside.add(self.states.get(words[-1], ""))
            words.pop()
        if len(words) == 1 and words[0] in self.states and len(words[0]) == 2:
            states, words = states or {self.states[words[0]]}, []
        if len(words) > 1 and " ".join(words) in self.states and not names:
            states, words = states or {self.states[" ".join(words)]}, []
        if words:
            got = self.choose(self.similar(words), states or inside, z)
            return (got[1][0], "similar", round(got[0], 4)) if got else (-1, "unlike all", 0.0)
        there = self.at_zip(z)
        fit = [e for e in there if e[2] in states] if states else there
        if len(z) == 5 and not fit:
            fit = there
        if not z and states:
            fit = [e for e in self.entries if e[2] in states]
        return (fit[0][0], "state and zip", 1.0) if len(fit) == 1 else (-1, "nothing usable", 0.0)


def map_places(records: DataFrame, reference: DataFrame, key: str = "id", city: str = "city", state: str = "state", zip: str = "zip") -> DataFrame:
    """The entry meant by the typed city, state and zip of each record.

    Columns: ``key``, ``fits`` (the typed values fit an entry as they stand),
    ``city_ref_id`` (-1 if unmatched), ``how`` ('as typed', 'mention', 'similar',
    'state and zip', 'unlike all', 'nothing usable') and ``score``.  The name counts
    before zip and state, which choose among entries of one name or of names about as
    similar; without a name they decide alone.  Equal names without any other hint
    give the entry of the least id.  Null, empty and blank values and placeholders
    are nothing typed.  Repeated rows stay repeated; an empty table gives an empty
    one, an empty list leaves all unmatched.  Other columns are not read.

    ``reference``: city_ref_id, city, state, state_name, zip_low, zip_high; at most
    MOST_ENTRIES rows, held by each worker.
    """
    entries = [tuple(r) for r in bounded_rows(reference.select("city_ref_id", "city", "state", "state_name", "zip_low", "zip_high"), MOST_ENTRIES, "canonical places")]
    entries.sort(key=lambda e: (e[0] is None, e[0] or 0))
    kind = records.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = Gazetteer(entries)
        exact = {(e[1], e[2]): e for e in entries}
        for b in batches:
            out = []
            for c, s, z in zip_columns(b["c"], b["s"], b["z"]):
                e = exact.get((c, s))
                if e and z and re.fullmatch(r"[0-9]{5}", z) and e[4] and e[5] and e[4] <= z <= e[5]:
                    out.append((True, e[0], "as typed", 1.0))
                else:
                    out.append((False, *g.find(c, s, z)))
            made = pd.DataFrame(out, columns=["fits", "city_ref_id", "how", "score"], index=b.index)
            made.insert(0, "k", b["k"])
            yield made

    cols = [records[x].alias(y) for x, y in ((key, "k"), (city, "c"), (state, "s"), (zip, "z"))]
    found = records.select(*cols).mapInPandas(run, f"k {kind}, fits boolean, city_ref_id bigint, how string, score double")
    return found.withColumnRenamed("k", key)


def zip_columns(*columns: pd.Series):
    """Rows of several columns, with None for what is missing."""
    return zip(*([x if isinstance(x, str) else None for x in c] for c in columns))
