"""The operators' results by the plainest means."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(docs, threshold=0.8):
    """[(doc_id, text)] -> {text: (smallest doc_id of its class, links, copies)}."""
    ids = defaultdict(list)
    for doc, text in docs:
        ids[text or ""].append(doc)
    texts = list(ids)
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = Counter()
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and common >= threshold * (len(sets[a]) + len(sets[b]) - common):
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    smallest = {}
    for i, t in enumerate(texts):
        known = [d for d in ids[t] if d is not None] + [smallest.get(find(i))]
        smallest[find(i)] = min((d for d in known if d is not None), default=None)
    return {t: (smallest[find(i)], links[i], len(ids[t])) for i, t in enumerate(texts)}


def rules(text, min_repeat):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, longest_repeat."""
    text = text or ""
    w = WORD.findall(text)
    n, at = len(w), defaultdict(list)
    for i in range(n - 2):
        at[tuple(w[i : i + 3])].append(i)
    windows, longest = set(), [0] * n
    for same in at.values():
        for i in same if len(same) > 1 else ():
            windows |= {i, i + 1, i + 2}
            for j in same:
                k = 3
                while i != j and max(i, j) + k < n and w[i + k] == w[j + k]:
                    k += 1
                longest[i] = max(longest[i], k if i != j else 0)
    covered = {p for i in range(n) if longest[i] >= min_repeat for p in range(i, i + longest[i])}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(windows), len(covered), max(longest, default=0))


def kept_by_rules(text, min_repeat, max_covered, max_longest):
    n, _, _, _, repeated, covered, longest = rules(text, min_repeat)
    return n >= 50 and 100 * repeated <= 50 * n and covered <= max_covered * n and longest <= max_longest


def cut(docs, length=50):
    """[(doc_id, text)] -> {(doc_id, text): (n_bytes, n_removed, n_spans, sha256)}."""
    first = {}
    for doc, text in docs:
        b = (text or "").encode()
        for j in range(len(b) - length + 1):
            w = b[j : j + length]
            first[w] = min(first.get(w, float("inf")), float("inf") if doc is None else doc)
    out = {}
    for doc, text in docs:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - length + 1):
            if first[b[j : j + length]] < (float("inf") if doc is None else doc):
                gone[j : j + length] = b"\1" * length
        kept = bytes(x for x, r in zip(b, gone) if not r)
        spans = sum(bool(r) and (j == 0 or not gone[j - 1]) for j, r in enumerate(gone))
        out[doc, text] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def leaks(docs, items):
    """(doc_id, item_id) of which at least 0.8 of the item's shingles are in the document in one item-sized window."""
    def tokens(text):
        return re.findall(r"[^\W_]+", (text or "").lower())

    found = set()
    for item, text in items:
        w = tokens(text)
        want = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        if not want:
            continue
        for doc, body in docs:
            b = tokens(body)
            grams = [tuple(b[i : i + 5]) for i in range(len(b) - 4)]
            for start in range(-len(w), len(b)):
                window = Counter(grams[max(start, 0) : max(0, start + len(w) - 4)])
                if sum((window & want).values()) >= 0.8 * sum(want.values()):
                    found.add((doc, item))
                    break
    return found


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(digits[::-1])) % 10 == 0


def personal(text):
    text = text or ""
    digits = re.compile(r"[^0-9]")
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := digits.sub("", m.group())) <= 19 and luhn(d)]
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits.sub("", m.group())) <= 15]
    return out


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """{source: size} -> {source: target}: shares by weight, excess over the caps shared again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out
