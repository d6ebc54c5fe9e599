"""Plain versions of the filtering stages, one text or pair at a time."""
import re

import regex

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def judged_kept(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    n = len(words)
    seen, dup, lines = set(), 0, 0
    for line in (t or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = [tuple(words[i:i + 3]) for i in range(n - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    hit = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    chars = sum(map(len, words))
    alpha = sum(bool(re.search(r"[a-zA-Z]|[^\x00-\x7f]", w)) for w in words)
    return not (n < 50 or 100 * len(hit) > 50 * n or len(re.findall(r"[#*$%&|<>]", t)) > 0.3 * n or 100 * dup > 60 * lines
                or chars < 2 * n or chars > 25 * n or 100 * alpha < 50 * n)


def jaccard_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                at[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def decontaminated(t, items):
    word = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(x))
    w = word(t)
    for item in items:
        v = word(item)
        n = min(10, len(v))
        if n and {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} & {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}:
            return False
    return True


def redacted(t, rules):
    spans = sorted((m.start(), n, m.end(), r.kind) for n, r in enumerate(rules)
                   for m in regex.finditer(ASSIGN if r.kind == "assign" else r.pattern, t) if len(m[r.group]) >= r.least)
    merged = []
    for start, _, end, kind in spans:
        if merged and merged[-1][1] > start:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end, kind])
    for start, end, kind in reversed(merged):
        t = t[:start] + f"<{kind}>" + t[end:]
    return t


def test_plain_versions():
    assert redacted("a token=abcdef b", __import__("chronoscribe.llm.secret", fromlist=["x"]).RULES) == "a <assign> b"
    assert not judged_kept("x") and decontaminated("a b", ["c"]) and not decontaminated("a b", ["b"])
