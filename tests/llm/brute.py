"""Plain forms of what the operators must give, for small tables."""

import hashlib
import re

import xxhash

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text, words=3):
    found = _WORD.findall((text or "").translate(_LOWER))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(marks, radius=3):
    """marks: id -> fingerprint; id -> smallest id reachable."""
    first = {}
    for i in sorted(marks):
        first.setdefault(marks[i], i)
    prints, group = list(first), {p: i for p, i in first.items()}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if group[b] < group[a] and (a ^ b).bit_count() <= radius:
                    group[a], changed = group[b], True
    return {i: group[p] for i, p in marks.items()}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def spans_text(spans, kinds):
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in sorted(spans))


def _luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        total += sum(divmod(int(c) * (i % 2 + 1), 10))
    return total % 10 == 0


def personal(text):
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)


def secrets(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def repeated_bytes(texts, least=200):
    """Per text whether each byte is covered by a string of ``least`` bytes that starts elsewhere too."""
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, b in enumerate(data):
        for i in range(len(b) - least + 1):
            seen.setdefault(b[i : i + least], []).append((d, i))
    cover = [[False] * len(b) for b in data]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                cover[d][i : i + least] = [True] * least
    return cover
