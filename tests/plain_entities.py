"""Detection by entities in plain Python, from the core on: the definition, a record at a time."""

import math
import re
from collections import Counter
from datetime import timedelta

import numpy as np

from quern.functions import fixed

UPPER, LOWER = "A-ZÄÖÅ", "a-zäöå"
NAMES = [re.compile(p, re.ASCII) for p in (rf"\b([{UPPER}][{UPPER}0-9]{{2,19}})\b", rf"\b([{UPPER}][{LOWER}]+[{UPPER}][a-zA-ZäöåÄÖÅ0-9]*)\b", rf"[{LOWER}.,;:]\s+([{UPPER}][a-zäöåA-ZÄÖÅ0-9]{{3,}})\b")]
NOISE = [re.compile(p, re.I) for p in (r"^\d+$", r"^\d{4}[-_]\d{2}", r"^(IS-|INC-|REF|REQ|SESD-|CAS-|CS\d)", r"^[0-9A-F]{6,}$", r"[/\\@]", r"^\d+\.\d+")]


def names(text):
    found = dict.fromkeys(w for p in NAMES for w in p.findall(text))
    return [w for w in found if w.lower() not in fixed.STOP_WORDS and not any(p.search(w) for p in NOISE)]


def entities(rows):
    """id -> (systems, actions, signature)."""
    nouns = {r["id"]: set(names(r["text"])) | set(names(" ".join(r["tags"]))) for r in rows}
    df = Counter(x for s in nouns.values() for x in s)
    fine = {x for x, k in df.items() if 2 <= k <= math.ceil(len(rows) * 0.5)} if len(rows) >= 5 else set()
    out = {}
    for r in rows:
        plain = " ".join(t for t in r["tags"] if not re.match(fixed.PRIORITY_TAG, t))
        systems = list(dict.fromkeys([*names(r["text"]), *sorted(names(plain)), *sorted(nouns[r["id"]] & fine)]))
        actions = [a for a in fixed.ACTIONS if re.search(rf"\b{a}\b", r["text"], re.I | re.ASCII)]
        out[r["id"]] = systems, actions, "|".join(sorted(systems) + actions[:1]) or "UNKNOWN"
    return out


def mean(a, b):
    s = [float(x @ y) for x in a for y in b if x is not None and y is not None]
    return sum(s) / len(s) if s else 0.0


def halves(ids, v):
    if len(ids) <= 15:
        return [ids]
    known = [v[i] for i in ids if v[i] is not None]
    centre = np.mean(known, axis=0) if known else None
    far = sorted(ids, key=lambda i: -(0.0 if v[i] is None else float(((v[i] - centre) ** 2).sum())))
    cut = math.ceil(len(far) / 2)
    return halves(far[:cut], v) + halves(far[cut:], v)


def by_cosine(ids, v):
    of = lambda g: [v[i] for i in g]
    groups = [[i] for i in ids]
    while len(groups) > 1:
        s, i, j = max((mean(of(groups[i]), of(groups[j])), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups)))
        if s < 0.45 or len(groups[-i]) + len(groups[-j]) > 15:
            break
        groups[-i] += groups.pop(-j)
    moved = True
    while moved:
        moved = False
        for k in range(len(groups) - 1, -1, -1):
            if k < len(groups) and len(groups[k]) < 2 and len(groups) > 1:
                fits = [(mean(of(groups[k]), of(g)), -j) for j, g in enumerate(groups) if j != k and len(g) < 15]
                if fits:
                    groups[-max(fits)[1]] += groups[k]
                    del groups[k]
                    moved = True
    return [p for g in groups for p in halves(g, v)]


def split(ids, signs, v):
    if len(ids) <= 15:
        return [ids]
    by = {}
    for i in ids:
        by.setdefault(signs[i], []).append(i)
    groups = list(by.values())
    if len(groups) < 2:
        return by_cosine(ids, v)
    large = [g for g in groups if len(g) > 1]
    if max(map(len, groups)) > 15 or len(large) < 2:
        return [p for g in groups for p in (by_cosine(g, v) if len(g) > 15 else [g])]
    for g in groups:
        if len(g) == 1:
            fits = [(mean([v[g[0]]], [v[i] for i in h]), -j) for j, h in enumerate(large) if len(h) < 15]
            large[-max(fits)[1] if fits else 0].append(g[0])
    return [p for g in large for p in halves(g, v)]


def trend(dates):
    dates = [d for d in dates if d is not None]
    if len(dates) < 3 or max(dates) - min(dates) < timedelta(days=7):
        return "ISOLATED"
    early = sum(d <= min(dates) + (max(dates) - min(dates)) / 2 for d in dates)
    return "ESCALATING" if len(dates) - early >= 2 * early else "RECURRING"


def most(lists):
    return Counter(x for one in lists for x in one).most_common()


def described(g, found):
    systems, actions = most(found[r["id"]][0] for r in g), most(found[r["id"]][1] for r in g)
    words = Counter(w for r in g for w in {w for w in r["text"].lower().split() if len(w) > 3})
    words = " ".join(w for w, k in sorted(words.items(), key=lambda x: (-x[1], x[0])) if k >= math.ceil(len(g) / 2)) if words else ""
    words = " ".join(words.split(" ")[:3])
    people = list(dict.fromkeys(r["person"] for r in g if r["person"]))
    s, a = [x for x, _ in systems], [x for x, _ in actions]
    if s:
        title = f"{s[0]} — {a[0]}" if a else f"{s[0]} + {s[1]}" if len(s) > 1 else f"{s[0]} — {words}" if words else f"{s[0]} ({people[0]})" if people else f"{s[0]} — relaterade ärenden"
    else:
        title = f"{a[0]} — blandade system" if a else words or f"Kluster ({len(g)} ärenden)"
    scope = "SINGLE" if len(people) <= 1 else "CROSS_PERSON" if len(people) <= 3 else "CROSS_TEAM"
    t = trend([r["date"] for r in g])
    kind = "ESCALATING" if t == "ESCALATING" else scope if scope != "SINGLE" else "RECURRING"
    parts = [f"{len(g)} ärenden", *(["System: " + ", ".join(f"{x} ({k})" for x, k in systems[:3])] if s else []), f"Scope: {scope}", f"Trend: {t}", "Rapportörer: " + ", ".join(people[:5])]
    sure = "HIGH" if len(g) >= 5 and s else "MEDIUM" if len(g) >= 3 else "LOW"
    return {"title": title, "description": ". ".join(parts) + ".", "pattern_type": kind, "scope": scope, "trend": t, "confidence": sure, "entities": s[:3], "ids": [r["id"] for r in g], "evidence": [(r["text"], r["person"] or "Okänd") for r in g[:3]]}


def detect(rows, vectors, cluster):
    """Patterns of one workspace's core, in input order; cluster(vectors) gives lists of places."""
    if len(rows) < 3:
        return []
    found = entities(rows)
    own = [vectors.get(r["id"]) for r in rows]
    unit = {r["id"]: None if x is None else np.asarray(x) / (np.linalg.norm(x) or 1) for r, x in zip(rows, own, strict=True)}
    by_id = {r["id"]: r for r in rows}
    out = []
    for g in cluster([None if x is None else np.asarray(x, float) for x in own]):
        ids = [rows[k]["id"] for k in g]
        if len(ids) > 1:
            out += [described([by_id[i] for i in p], found) for p in split(ids, {i: found[i][2] for i in ids}, unit) if len(p) > 1]
    count, seen = Counter(p["title"] for p in out), Counter()
    for p in out:
        t = p["title"]
        if count[t] > 1:
            seen[t] += 1
            p["title"] = f"{t} ({p['evidence'][0][1]})" if seen[t] <= 2 else f"{t} #{seen[t]}"
    return out
