"""An independent model of routing, candidates and search in plain numpy and loops, with the same planes."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np


def density(x, n, mean, m2):
    k, a = n + 0.01, n / 2 + 0.01
    mu, b = n * mean / k, 0.01 + m2 / 2 + 0.01 * n * mean * mean / (2 * (n + 0.01))
    nu, s2 = 2 * a, b * (k + 1) / (a * k)
    return math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * s2) - (nu + 1) / 2 * math.log1p((x - mu) ** 2 / (nu * s2))


def root_score(q, x):
    return sum(density(q[j], len(x), x[:, j].mean(), x[:, j].var() * len(x)) for j in range(x.shape[1]))


def route(scores, delta):
    s = np.array(scores)
    p = np.exp(s - s.max())
    p /= p.sum()
    out, total = [], 0.0
    for i in sorted(range(len(s)), key=lambda i: (-s[i], i)):
        if total >= 1 - delta:
            break
        out.append(i)
        total += p[i]
    return out


def evidence(q, x, planes, radius):
    out = defaultdict(lambda: [0.0, 0])
    bits = planes.bits
    sig, proj = planes.signatures(x), planes.projections(x).reshape(len(x), planes.tables, -1)
    qs, qp = planes.signatures(q[None])[0], planes.projections(q[None]).reshape(planes.tables, -1)
    for t in range(planes.tables):
        flips = {0} | ({1 << b for b in range(bits)} if radius else set()) | ({1 << a | 1 << b for a in range(bits) for b in range(a)} if radius > 1 else set())
        for f in flips:
            want = (int(qs[t]) & (1 << 64) - 1) ^ f
            rows = np.flatnonzero(sig[:, t].view(np.uint64) == np.uint64(want))
            if len(rows):
                part = proj[rows, t]
                fit = sum(density(qp[t, j], len(rows), part[:, j].mean(), part[:, j].var() * len(rows)) for j in range(part.shape[1]))
                p = len(rows) / len(x)
                for r in rows:
                    out[int(r)][0] += fit + math.log(len(rows) + 1) + 0.25 * p * math.log(p)
                    out[int(r)][1] += 1
    return out


def budget(ev, config):
    ranked = sorted(((s, v, -r) for r, (s, v) in ev.items()), reverse=True)
    s1, v1, _ = ranked[0]
    s2, v2 = (ranked[1][0], ranked[1][1]) if len(ranked) > 1 else (s1 - 1, 0)
    unit = lambda z: min(max(z, 0.0), 1.0)
    top = 1 / sum(math.exp(s - s1) for s, *_ in ranked[:16])
    lead = unit((s1 - s2) / (abs(s1) + 1e-6))
    votes = unit(0.7 * unit(v1 / config.lsh_num_tables) + 0.3 * unit((v1 - v2) / config.lsh_num_tables))
    sure = unit(0.55 * votes + 0.3 * top + 0.15 * lead)
    low, high = config.lsh_min_candidates, config.lsh_max_candidates
    n = int(min(max(math.floor(low + (high - low) * (1 - sure) ** config.lsh_adaptive_gamma + 0.5), low), high))
    return n, [-r for _, _, r in ranked[:n]]


def sq8(x):
    lo, hi = x.min(axis=0), x.max(axis=0)
    code = np.clip(np.floor((x - lo) / np.maximum(hi - lo, 1e-12) * 255 + 0.5), 0, 255)
    return lo + (hi - lo) / 255 * code


def search(q, parts, ids, planes, config, k, delta):
    """(id, distance) of the k nearest by decoded distance, through routing and candidates."""
    radius = config.lsh_probe_hamming_radius if delta < 0.2 else min(config.lsh_probe_hamming_radius, 1) if delta < 0.5 else 0
    best = {}
    for s in route([root_score(q, x) for x in parts], delta):
        ev = evidence(q, parts[s], planes, radius)
        if not ev:
            continue
        y = sq8(parts[s])
        for r in budget(ev, config)[1]:
            d = float(np.sqrt(((q - y[r]) ** 2).sum()))
            best[ids[s][r]] = min(best.get(ids[s][r], math.inf), d)
    return sorted(((d, i) for i, d in best.items()))[:k]
