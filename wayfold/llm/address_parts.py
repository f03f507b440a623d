"""Parts of a freely typed postal address, as one line or as typed components."""

from __future__ import annotations

import re
import unicodedata

from wayfold.functions.postal import DIRECTIONS, STREET_TYPES
from wayfold.llm.places import AROUND, Gazetteer, alike, clean_zip, plain

UNIT = re.compile(r"(?:\b(?:apartment|apt|suite|ste|unit|un)\b\.?\s*(?:no\.?\s*)?#?\s*([0-9]+[a-z]?|[a-z])\b|\b(?:apartment|apt|suite|ste|unit|un)([0-9]+[a-z]?)\b|#\s*([0-9]+[a-z]?|[a-z])\b)")
UNIT_LEFT = re.compile(r"\b(?:apartment|apt|suite|ste|unit|un)\b\.?\s*#?\s*(?=$|[,;|])|#(?=\s*(?:$|[,;|]))")
BOX = re.compile(r"\b(?:p\s*\.?\s*o\s*\.?\s*box|post\s+office\s+box|postal\s+box|pob|p\s*\.?\s*o\s*\.?\s*b|box)\b\.?\s*#?\s*([0-9]+)\b")
ZIP = re.compile(r"(?<![\w-])([\dol]{5})(?:-[\dol]{4}|\.0)?(?![\w-])|(?<![\w-])(\d{9})(?![\w-])")
COUNTRY = re.compile(r"\b(?:united states(?: of america)?|u\.?s\.?a\.?|us)\s*$|\b(?:united states(?: of america)?|usa)\b")
CARE = re.compile(r"^\s*(?:attn|attention|c/o|care of|rear|front|upper|lower|mail room)\b|\b(?:plaza|tower|building|bldg|complex|center|centre|mall|campus|annex|floor|lobby)\s*$")
URB = re.compile(r"\burb(?:anizacion|anization)?\b\.?\s*([a-z ]*)")
CALLE = re.compile(r"\b(?:calle|cll|cl|c/)(?=[\s.])\.?")
SPLIT = re.compile(r"[,;|\n\r]+|\s-\s")
TWO_DIR = re.compile(r"\b([ns])\s*\.\s*([ew])\s*\.?(?=\s|$)|\b([ns])\s([ew])\b(?=\s)")
POINTS = {"n", "s", "e", "w", "ne", "nw", "se", "sw"}


def fold(text: str | None) -> str:
    """Lower case without marks; joined CamelCase words are parted, hyphens within words are spaces."""
    t = text or ""
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    t = re.sub(r"(?<=[a-z])(?=[A-Z][a-z])", " ", t).lower()
    return re.sub(r"(?<=[a-z])-(?=[a-z])", " ", t.replace("\t", " "))


def digits(word: str) -> str:
    return word.replace("o", "0").replace("l", "1").replace("i", "1") if re.fullmatch(r"[\doli]*\d[\doli]*", word) else word


def letters(word: str) -> str:
    """A word of letters in which 0 and 1 stand for o and l."""
    return word.replace("0", "o").replace("1", "l") if re.search(r"[a-z].*[a-z].*[a-z]", word) and re.search(r"[a-z][01]|[01][a-z]", word) and not word[0].isdigit() else word


class Parser:
    """Parses with the help of the canonical places."""

    def __init__(self, gazetteer: Gazetteer):
        self.g = gazetteer

    def parse(self, line: str | None, city: str | None = None, state: str | None = None, zip_: str | None = None, whole: bool = False) -> dict:
        """``whole``: the line holds the place too.  Missing parts are empty."""
        out = dict.fromkeys(("number", "direction", "type", "unit", "urb", "box", "town", "state", "zip"), "") | {"name": [], "city": -1}
        t = fold(line)
        t = COUNTRY.sub(" ", t.strip().rstrip(".")) if whole else t
        z = clean_zip(zip_)
        if whole:
            found = [m for m in ZIP.finditer(t) if sum(c.isdigit() for c in m.group()) >= 3]
            if found:
                m = found[0] if found[0].start() == 0 and len(found) == 1 else found[-1]
                z = clean_zip(m.group())
                t = t[: m.start()] + " | " * (m.start() == 0) + t[m.end() :]
        out["zip"] = z
        if m := BOX.search(t):
            out["box"] = m.group(1).lstrip("0") or "0"
            t = t[: m.start()] + " , " + t[m.end() :]
        if m := UNIT.search(t):
            out["unit"] = next(x for x in m.groups() if x).upper().lstrip("0")
            t = t[: m.start()] + (" , " if whole else " ") + t[m.end() :]
        t = UNIT_LEFT.sub(" ", t)
        calle = bool(CALLE.search(t))
        t = CALLE.sub(" ", t)
        t = TWO_DIR.sub(lambda m: "".join(x for x in m.groups() if x), t)
        parts = [[letters(w) for w in re.findall(r"[a-z0-9]+", p)] for p in SPLIT.split(t) if not CARE.search(p)]
        parts = [p for p in parts if p]
        if whole:
            parts = self._place(parts, out, z)
        else:
            c, s = city, state
            got, how, _ = self.g.find(c, s, z or zip_)
            out["city"] = got
            st = self.g.state_choices(s) or self.g.state_choices(c)
            out["state"] = next(iter(st)) if len(st) == 1 else ""
            if got < 0 and how == "unlike all":
                words = [w for w in plain(c).replace("0", "o").split() if not w.isdigit()]
                if self.g.state(c) and not self.g.state(s) and plain(s):
                    words = plain(s).split()
                if len(words) > 1 and words[-1] in self.g.states:
                    out["state"] = out["state"] or self.g.states[words[-1]]
                    words = words[:-1]
                out["town"] = self._town(words)
                found5 = re.findall(r"\d{5}", c or "")
                out["zip"] = z or (found5[-1] if found5 else "")
        self._street(parts, out, calle)
        if out["urb"] or calle:
            out["type"] = "calle"
        return out

    def _town(self, words: list[str]) -> str:
        return "".join(w for w in Gazetteer.full(" ".join(w for w in words if w not in ("city", "limits", "of", "town"))).split())

    def _place(self, parts: list[list[str]], out: dict, z: str) -> list[list[str]]:
        """Takes town and state out of the parts of a one-line address."""
        g = self.g
        there = g.at_zip(z)
        states: set[str] = set()
        # A state stands at the end of a part, most likely of the last one.
        for i in sorted(range(len(parts)), key=lambda i: (any(w.isdigit() for w in parts[i]) and len(parts) > 1, -i)):
            p = parts[i]
            street = any(any(c.isdigit() for c in w) for w in p)
            for k in (3, 2, 1):
                if len(p) >= k and not states:
                    words = " ".join(p[-k:])
                    one = g.states.get(words) or (g.state(words) if not street and k == len(p) and len(words) > 3 and not g.mentions(words)[0] else None)
                    if one is None:
                        continue
                    if street and p[-1] in STREET_TYPES and (len(p) < 5 or there and all(e[2] != one for e in there)):
                        continue
                    if street and len(p) - k < 2:
                        continue
                    states, parts[i] = {one}, p[:-k]
            if states:
                break
        if len(states) == 1:
            out["state"] = next(iter(states))
        parts = [p for p in parts if p]
        # An exact mention of a name or alias; the best supported one.
        best = None
        for i, p in enumerate(parts):
            names, _ = g.mentions(" ".join(p).replace("0", "o") if not any(w.isdigit() for w in p) else " ".join(p))
            for n in names:
                got = g.choose([(1.0, n)], states, z)
                if got:
                    e = got[1]
                    rank = ((e in there) + (e[2] in states), not any(w.isdigit() for w in p), len(n))
                    if best is None or rank > best[0]:
                        best = (rank, i, n, e)
        if best:
            _, i, n, e = best
            out["city"] = e[0]
            for form in sorted(g.name_forms[n], key=len, reverse=True):
                w = form.split()
                q = [x.replace("0", "o") if not x.isdigit() else x for x in parts[i]]
                at = [j for j in range(len(q) - len(w) + 1) if q[j : j + len(w)] == w]
                if at:
                    rest = parts[i][at[-1] + len(w) :]
                    front = parts[i][: at[-1]]
                    while rest and rest[0] in AROUND:
                        rest = rest[1:]
                    while front and front[-1] in ("of", "city", "town"):
                        front = front[:-1]
                    parts[i] = front
                    parts.insert(i + 1, rest)
                    break
            return [p for p in parts if p]
        # A window of words like a name expected by zip or state, then like any name.
        expected = {g.full(plain(e[1])) for e in there}.union(*(g.by_state[st] for st in states))
        top = (0.0, 0, 0, 0, "")
        for i, p in enumerate(parts):
            first = next((j for j, w in enumerate(p) if any(c.isdigit() for c in w) and not re.search(r"[a-z]{3}", w)), -1)
            for n in expected:
                joined, size = n.replace(" ", ""), len(n.split())
                for k in {max(1, size - 1), size, size + 1}:
                    for a in {0, len(p) - k} if first < 0 else {len(p) - k}:
                        if a <= first + (1 if first >= 0 else 0) - (first < 0) or a < 0 or a + k > len(p):
                            if not (first < 0 and a == 0 and k <= len(p)):
                                continue
                        w = p[a : a + k]
                        s = max(alike("".join(w), joined), alike(g.full(" ".join(w)).replace(" ", ""), joined))
                        s += 0.02 * (first < 0 and k == len(p))
                        if s > top[0]:
                            top = (s, i, a, k, n)
        if top[0] >= 0.72:
            s, i, a, k, n = top
            got = g.choose([(s, n)], states, z) or g.choose([(1.0, n)], states, z)
            out["city"] = got[1][0]
            parts[i : i + 1] = [parts[i][:a], parts[i][a + k :]]
            return [p for p in parts if p]
        for i, p in enumerate(parts):
            if any(any(c.isdigit() for c in w) for w in p) and not all(re.search(r"[a-z]{3}", w) for w in p) or p[0] == "urb":
                continue
            words = [w for w in g.full(" ".join(p)).split() if w not in AROUND]
            got = g.choose(g.similar(words), states, z) if words else None
            if got and len(parts) > 1:
                out["city"] = got[1][0]
                return [q for j, q in enumerate(parts) if j != i]
        # A town that isn't listed: a part of its own, or what follows the street type.
        free = [i for i, p in enumerate(parts) if not any(any(c.isdigit() for c in w) for w in p) and p[0] not in ("urb", "urbanizacion")]
        if free and (len(parts) > 1 or out["box"]) and (out["box"] or len(free) < len(parts)):
            i = free[-1]
            out["town"] = self._town(parts[i])
            return [p for j, p in enumerate(parts) if j != i]
        for i, p in enumerate(parts):
            at = [j for j, w in enumerate(p[:-1]) if w in STREET_TYPES and j >= 2]
            if at and not (len(p) - at[-1] - 1 == 1 and (p[-1] in POINTS or p[-1] in DIRECTIONS)):
                out["town"] = self._town(p[at[-1] + 1 :])
                parts[i] = p[: at[-1] + 1]
                return parts
        if there and len(there) == 1 and z:
            out["city"] = there[0][0]
        return parts

    def _street(self, parts: list[list[str]], out: dict, calle: bool) -> None:
        """Number, direction, name, type and urbanization from what is left."""
        urb: list[str] = []
        for i, p in enumerate(parts):
            if p[0] in ("urb", "urbanizacion", "urbanization"):
                k = next((j for j, w in enumerate(p) if w.isdigit()), len(p))
                urb, parts[i] = p[1:k], p[k:]
            elif any(w in ("urb", "urbanizacion", "urbanization") for w in p):
                k = next(j for j, w in enumerate(p) if w in ("urb", "urbanizacion", "urbanization"))
                urb, parts[i] = p[k + 1 :], p[:k]
        out["urb"] = "".join(urb)
        parts = [p for p in parts if p]
        if not parts:
            return
        main = next((p for p in parts if any(c.isdigit() for c in p[0])), None) or next((p for p in parts if any(w.isdigit() for w in p)), None)
        if main is None:
            main = next((p for p in parts if p[-1] in STREET_TYPES), None) or max(parts, key=lambda p: sum(map(len, p)))
        words = list(main)
        for j, w in enumerate(words[:3]):
            if (d := digits(w)).isdigit():
                out["number"] = d.lstrip("0") or "0"
                words = words[j + 1 :]
                break
            if m := re.fullmatch(r"(\d+)([a-z]{3,})", w):
                out["number"], words = m.group(1), [m.group(2), *words[j + 1 :]]
                break
        else:
            late = [j for j, w in enumerate(words[:-1]) if w.isdigit() and len(w) < 5 and j > 2]
            if late:  # the place stands before the street, without a mark between them
                out["number"], words = words[late[-1]].lstrip("0") or "0", words[late[-1] + 1 :]
        if len(words) == 0 and len(parts) > 1:
            words = list(next((p for p in parts if p is not main), []))

        def point(w: str) -> str:
            return w if w in POINTS else DIRECTIONS.get(w, "")

        if len(words) > 1 and point(words[0]):
            out["direction"], words = point(words[0]), words[1:]
        if len(words) > 1 and point(words[-1]) and not out["direction"]:
            out["direction"], words = point(words[-1]), words[:-1]
        if len(words) > 1 and not calle and words[-1] in STREET_TYPES:
            out["type"], words = STREET_TYPES[words[-1]], words[:-1]
        elif len(words) > 2 and not calle and len(words[-1]) > 4:
            near = {v for k, v in STREET_TYPES.items() if len(k) > 4 and alike(words[-1], k) >= 0.8}
            if len(near) == 1 and len(words) > 2:
                out["type"], words = near.pop(), words[:-1]
        if len(words) > 1 and point(words[-1]) and not out["direction"]:
            out["direction"], words = point(words[-1]), words[:-1]
        out["name"] = [w for w in words if not w.isdigit()] or words
