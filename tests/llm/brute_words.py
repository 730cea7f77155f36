"""Plain Python versions of the operators on words, phrases and personal data."""

from __future__ import annotations

import re
import zlib
from collections import Counter

from tests.llm.brute import LOWER

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def spelling_words(rows):
    """Counts of the words of ``(doc_id, text)`` rows."""
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def spelling_forms(rows):
    words = spelling_words(rows)
    out = {}
    for w, n in words.items():
        near = [(-m, v) for v, m in words.items() if one_edit(w, v)]
        best = min(near, default=None)
        form = best if best and -best[0] >= 2 * n else None
        out[w] = (form[1] if form else None, n, len(near), -form[0] if form else None)
    for w, (form, *rest) in list(out.items()):
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w] = (form, root, *rest) if len(out[w]) == 4 else out[w]
    return out


def phrases(rows, least=30, best=2000):
    """Ranked phrases of ``(lang, text)`` rows."""
    counts, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(2000000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], score)
    kept = {
        (lang, p): v for (lang, p), v in found.items()
        if not any(
            len(q) > len(p) and other == lang and 100 * w[0] >= 80 * v[0]
            and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), w in found.items())
    }
    out = []
    for lang in n:
        mine = sorted((-v[3], -v[0], " ".join(p).encode(), v) for (x, p), v in kept.items() if x == lang)
        out += [(lang, i, p.decode(), a, l, r, n[lang], s) for i, (_, _, p, (a, l, r, s)) in enumerate(mine[:best], 1)]
    return sorted(out)


def personal_base(text):
    """Spans of the fixed kinds as their patterns say; slow on long runs."""
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c not in " -"]
        if 14 <= len(d) <= 19 and sum(d[-1::-2] + [(2 * x) // 10 + (2 * x) % 10 for x in d[-2::-2]]) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.findall("[0-9]", m[0])) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def personal_words(text):
    return [w for w in re.split("[ \t-\r]+", re.sub(r"""([=:;,()<>\[\]{}"'|])""", r" \1 ", text.translate(LOWER))) if w]


def personal_scores(texts, support=5, confidence=0.5, known=0.5, rounds=3):
    """Scores of identifiers by pattern and entity, from the definitions; the places of each text come
    from the operator's helpers."""
    from cohortlens.llm import personal

    places, pairs = [], Counter()
    for text in texts:
        words = personal_words(text)
        pairs.update(zip(words, words[1:], strict=False))
        spans = personal.base_spans(text)
        for a, b, seed in [(a, b, True) for a, _, b in spans] + [(a, b, False) for a, b in personal.identifiers(text, spans)]:
            places.append((text[a:b].translate(LOWER), seed, personal.context(text, a, b)))
    seeds, scores = {e for e, seed, _ in places if seed}, {}
    for _ in range(rounds):
        weight = lambda e: 1.0 if e in seeds else scores.get(e, 0.0)
        held, entities = Counter(), {}
        for e, _, sides in places:
            for p in sides:
                if p:
                    held[p] += weight(e)
                    entities.setdefault(p, set()).add(e)
        good = {
            p: held[p] / pairs[p] for p, es in entities.items()
            if sum(weight(e) >= known for e in es) >= support and held[p] / pairs[p] >= confidence
        }
        total, n = Counter(), Counter()
        for e, seed, sides in places:
            if not seed:
                total[e] += max(good.get(p, 0.0) for p in sides)
                n[e] += 1
        scores = {e: total[e] / n[e] for e in n}
    return scores
