"""The pipeline's stages in plain Python, each by its definition, for small fixtures."""

import re
from collections import Counter, defaultdict

import numpy as np

SPACE = " \t\n\r\x0b\x0c"
FLOORS = (0.5, 0.05, 0.35, 0.5, 0.12)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def statistics(c):
    n, chars, symbols, dup, rep = c
    raw = (np.log(n), np.log(chars / n), np.log1p(100 * symbols / chars), np.log1p(dup), np.sqrt(rep / n))
    return [np.floor(v * 256 + 0.5) / 256 for v in raw]


def quantile_of_chi_square(q, p):
    """By integrating the density."""
    from math import gamma

    x = np.linspace(0, 120, 2_400_001)[1:]
    density = x ** (p / 2 - 1) * np.exp(-x / 2) / (2 ** (p / 2) * gamma(p / 2))
    return x[np.searchsorted(np.cumsum(density) * (x[1] - x[0]), q)], lambda v: float((density[x <= v]).sum() * (x[1] - x[0]))


def cdf_of_chi_square(v, p):
    return quantile_of_chi_square(0.5, p)[1](v)


def distance(x, centre, cov):
    d = x - centre
    return np.maximum(np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d), 0)


def robust(x, support=0.75):
    """Concentration steps from medians and quartile spreads; the nearest rows are rounded up to bins of the distance."""
    p, floor = x.shape[1], np.diag(np.square(FLOORS))
    scale = support / cdf_of_chi_square(quantile_of_chi_square(support, p)[0], p + 2)
    q = np.percentile(x, [25, 50, 75], axis=0)
    centre, cov, det = q[1], np.diag(((q[2] - q[0]) / 1.349) ** 2) + floor, np.inf
    while True:
        bins = np.minimum(np.floor(np.log1p(distance(x, centre, cov)) * 64), 1023)
        order = np.sort(bins)
        near = x[bins <= order[int(np.ceil(support * len(x))) - 1]]
        new_centre, new_cov = near.mean(axis=0), scale * np.cov(near.T, bias=True) + floor
        new_det = np.linalg.slogdet(new_cov)[1]
        if not new_det < det - 1e-3:
            return centre, cov
        centre, cov, det = new_centre, new_cov, new_det


def kept_by_quality(rows, weight=50, quantile=0.9999999):
    """Truth of ``kept`` and the squared distance (None where the base rules fail) of (text, lang, source) rows."""
    c = [counts(t) for t, _, _ in rows]
    good = [i for i, (n, _, _, _, rep) in enumerate(c) if not (n < 50 or 100 * rep > 50 * n)]
    x = {i: np.array(statistics(c[i])) for i in good}
    groups = defaultdict(list)
    for i in good:
        for g in (("own", *rows[i][1:]), ("language", rows[i][1]), ("all",)):
            groups[g].append(i)
    fit = {g: robust(np.array([x[i] for i in members])) for g, members in groups.items()}
    limit = quantile_of_chi_square(quantile, len(FLOORS))[0]

    def mixed(g, towards):
        w = len(groups[g]) / (len(groups[g]) + weight)
        return [w * a + (1 - w) * b for a, b in zip(fit[g], towards)]

    far = {}
    for i in good:
        language = mixed(("language", rows[i][1]), fit["all",])
        far[i] = float(distance(x[i][None], *mixed(("own", *rows[i][1:]), language))[0])
    return [i in far and far[i] <= limit for i in range(len(rows))], [far.get(i) for i in range(len(rows))]


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(texts, size=5, least=0.8):
    """Root of each text: the first one it is linked with, through any others."""
    sets = []
    for t in texts:
        w = words(lowered(t))
        sets.append({tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if root[a] != root[b] and (sets[a] == sets[b] or sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    return root


def holds_window(text, items, size=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    has = lambda w, part: any(w[i:i + len(part)] == part for i in range(len(w) - len(part) + 1))
    w = cut(text)
    for item in map(cut, items):
        if item and any(has(w, item[i:i + size]) for i in range(max(1, len(item) - size + 1))):
            return True
    return False


KINDS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    "secret": (r'(?<=token = ")[0-9a-f]{40}(?=")', lambda m, d: True),  # the only further spans that the fixture holds
}


def redacted(text):
    spans = sorted((m.start(), m.end(), k) for k, (p, fine) in KINDS.items() for m in re.finditer(p, text) if fine(m[0], re.sub("[^0-9]", "", m[0])))
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind.upper()}>"]
        at = max(at, end)
    return "".join(out) + text[at:]
